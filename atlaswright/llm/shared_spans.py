"""Long exact spans shared between texts, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.session import cut, forget

ROUNDS = 4
RUNS_AT = (0, 2)  # rounds that name runs before pairs
KEPT = (0,)  # levels kept, besides single characters, for windows that no higher symbol is certain in
PIECE = 100_000  # characters worked on at once
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Prints:
    """64-bit fingerprints of all spans of one string: sums of hashed characters times powers of a base."""

    _power = _inverse = np.ones(1, np.uint64)

    def __init__(self, hashed: np.ndarray):
        n = len(hashed)
        if n + 1 > len(Prints._power):
            size = max(n + 1, PIECE + 1000)
            for attr, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                setattr(Prints, attr, np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, base, np.uint64))]))
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(hashed * Prints._power[:n], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self._sum[end] - self._sum[start]) * Prints._inverse[start]
        return _mix(x + (end - start).astype(np.uint64) * _A)


def tokens(codes: np.ndarray, gaps: np.ndarray, prints: Prints) -> tuple:
    """(names, left, right, gaps) of the tokens of a text: a word with what follows it up to the next word.

    A token begins where a letter or digit comes after something else. Whether one begins is seen from two characters, so a token's ground is itself with one
    character on either side.
    """
    word = (codes >= 128) | _ASCII_WORDS[np.minimum(codes, 127)]
    begins = gaps.copy()
    begins[1:] |= (word[1:] & ~word[:-1]) | gaps[:-1]
    begins[0] = True
    at = np.flatnonzero(begins)
    end = np.append(at[1:], len(codes))
    names = prints.of(at, end)
    return names, np.maximum(at - 1, 0).astype(np.int32), np.minimum(end + 1, len(codes)).astype(np.int32), gaps[at]


_ASCII_WORDS = np.array([chr(c).isalnum() for c in range(128)])


def recompress(name: np.ndarray, left: np.ndarray, right: np.ndarray, gap: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of symbols over tokens, the kept lower ones first: (names, left, right), in text order.

    Every round names maximal runs of a symbol (in some rounds) and then pairs: by a bit of its name each
    symbol is a first or a second one, and a first before a second becomes a pair. A name is a hash of
    what it is made of, so it is the same in every text and every task, without any exchange.

    ``left`` and ``right`` bound a symbol's ground: the span whose characters alone bring about that symbol.
    A pair's ground is that of its two parts; a first (second) one that stays single needs its right (left) neighbour's ground too, a run both
    neighbours'. Where a span occurs again, every symbol whose ground it holds occurs in it again. ``gap`` marks
    places between texts, which belong to no ground of a usable symbol.
    """
    levels = []
    for k in range(ROUNDS):
        if k in KEPT:
            levels.append((name, left, right))
        if k in RUNS_AT and len(name) > 2:
            new = np.empty(len(name), bool)
            new[0] = True
            np.not_equal(name[1:], name[:-1], out=new[1:])
            new |= gap
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(name)))
            before, after = np.maximum(at - 1, 0), np.minimum(at + length, len(name) - 1)
            own = name[at]
            name = np.where(length > 1, _mix(own ^ (length.astype(np.uint64) * _B)), own)
            left, right, gap = left[before], right[after], gap[at]
        second = (_mix(name + np.uint64((k + 1) * int(_C) % (1 << 64))) >> np.uint64(63)).astype(bool)
        first = ~second & ~gap
        second &= ~gap
        pair = np.zeros(len(name), bool)
        np.logical_and(first[:-1], second[1:], out=pair[:-1])
        keep = np.ones(len(name), bool)
        np.logical_not(pair[:-1], out=keep[1:])
        at = np.flatnonzero(keep)
        new, both = name[at], np.flatnonzero(pair[at])
        new[both] = _mix(new[both] * _A + _mix(name[at[both] + 1] + _B))
        left, right, gap = left[at - second[at]], right[at + first[at]], gap[at]
        name = new
    levels.append((name, left, right))
    return levels


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All indices of the ranges [lo, hi), one after the other."""
    n = np.maximum(hi - lo, 0)
    if not n.sum():
        return np.zeros(0, np.int64)
    first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first + np.arange(n.sum())


def _anchors(level: tuple, a: np.ndarray, b: np.ndarray, width: int) -> tuple:
    """For window starts in the ranges [a, b): rows (symbol, from, to) with one symbol for each window, and ranges without.

    A window's symbol is, of those whose ground it holds, that of the least hash (the leftmost, if it occurs
    twice): it follows from the window's characters alone.
    """
    name, left, right = level
    left, right = left.astype(np.int64), right.astype(np.int64)
    i = _spread(np.searchsorted(left, a, "left"), np.searchsorted(left, b, "left"))
    j = _spread(np.searchsorted(right, a + width, "left"), np.searchsorted(right, b + width, "left"))
    cuts = np.unique(np.concatenate([a, b, left[i] + 1, right[j] - width]))
    start, end = cuts[:-1], cuts[1:]
    of = np.searchsorted(a, start, "right") - 1
    ok = (of >= 0) & (start < b[np.maximum(of, 0)])
    start, end, of = start[ok], end[ok], of[ok]
    lo = np.searchsorted(left, start, "left")
    hi = np.searchsorted(right, start + width, "right") - 1
    none = lo > hi
    rest = start[none], end[none]
    start, end, of, lo, hi = (x[~none] for x in (start, end, of, lo, hi))
    if not len(start):
        return (start, start, start), rest
    rank = _mix(name ^ _C)
    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
    best = np.arange(len(name))
    table = [best]
    for s in range(int(k.max())):
        other = table[-1][1 << s :]
        mine = table[-1][: len(other)]
        table.append(np.where(rank[mine] <= rank[other], mine, other))
    x, y = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
    for s, t in enumerate(table):
        at = np.flatnonzero(k == s)
        x[at], y[at] = t[lo[at]], t[hi[at] - (1 << s) + 1]
    got = np.where(rank[x] <= rank[y], x, y)
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (start[1:] != end[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(got)) - 1
    return (got[head], start[head], end[tail]), rest


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_rows(texts: list[str], width: int) -> tuple:
    """Rows (key, text number, first, windows, digests): windows of ``width`` characters in a row that share a symbol.

    ``key`` is the fingerprint of the symbol's ground, the digest that of all characters of the row's windows.
    """
    # gaps before, between and after the texts, so that every symbol has neighbours
    parts, bounds, at = [np.zeros(1, np.uint32)], [], 1
    for t in texts:
        c = _codes(t)
        parts += [c, np.zeros(1, np.uint32)]
        bounds.append((at, at + len(c)))
        at += len(c) + 1
    codes = np.concatenate(parts)
    hashed = _mix(codes * _A + _C)
    bounds = np.array(bounds, np.int64)
    gaps = np.zeros(len(hashed), bool)
    gaps[0] = True
    gaps[bounds[:, 1]] = True
    long = np.flatnonzero(bounds[:, 1] - bounds[:, 0] >= width)
    a, b = bounds[long, 0], bounds[long, 1] - width + 1
    prints = Prints(hashed)
    out = []
    place = np.arange(len(hashed), dtype=np.int32)
    levels = [(hashed, place, place + np.int32(1)), *recompress(*tokens(codes, gaps, prints))]
    for depth in range(len(levels) - 1, -1, -1):
        if not len(a):
            break
        (sym, lo, hi), (ra, rb) = _anchors(levels[depth], a, b, width)
        _, left, right = levels[depth]
        key = prints.of(left[sym].astype(np.int64), right[sym].astype(np.int64)) + np.uint64(depth)
        text = np.searchsorted(bounds[:, 0], lo, "right") - 1
        out.append((key, text, lo, hi - lo))
        if len(ra):
            # neighbouring ranges of one text become one again
            new = np.ones(len(ra), bool)
            same = np.searchsorted(bounds[:, 0], ra, "right")
            new[1:] = (ra[1:] != rb[:-1]) | (same[1:] != same[:-1])
            head = np.flatnonzero(new)
            ra, rb = ra[head], rb[np.append(head[1:], len(rb)) - 1]
        a, b = ra, rb
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), [])
    key, text, lo, n = (np.concatenate(c) for c in zip(*out))
    return key.view(np.int64), text, lo - bounds[text, 0], n, _digests(codes, lo, lo + n - 1 + width)


def _digests(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Cryptographic digests of 128 bits of spans of characters: equal ones stand for equal characters."""
    raw = memoryview(np.ascontiguousarray(codes, np.uint32)).cast("B")
    return [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((start * 4).tolist(), (end * 4).tolist())]


def _symbol_rows(docs: DataFrame, width: int) -> DataFrame:
    """``key, whole, doc_id, first, n``: for every run of windows with one symbol."""
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        size = 0

        def work() -> pa.RecordBatch:
            key, text, first, n, whole = window_rows([t for _, _, t in held], width)
            ids, shift = np.array([d for d, _, _ in held], np.int64), np.array([s for _, s, _ in held], np.int64)
            cols = [pa.array(key), pa.array(whole, pa.binary()), pa.array(ids[text]), pa.array((first + shift[text]).astype(np.int32)), pa.array(n.astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, names=["key", "whole", "doc_id", "first", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                # a longer text goes in pieces that share all but one character of a window
                for at in range(0, max(1, len(text) - width + 1), PIECE):
                    piece = text[at : at + PIECE + width - 1] if len(text) > PIECE else text
                    held.append((doc, at, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield work()
                        held, size = [], 0
        if held:
            yield work()

    return docs.mapInArrow(rows, "key long, whole binary, doc_id long, first int, n int")


def _window_digests(texts: DataFrame, width: int) -> DataFrame:
    """``key, whole, lo, hi, at, print``: each window of the variants (of one text) listed in ``reps``."""
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for text, reps in zip(b.column(0), b.column(1).to_pylist()):
                codes = _codes(text.as_py())
                first, n = np.array([r["first"] for r in reps]), np.array([r["n"] for r in reps])
                starts = _spread(first, first + n)
                of = np.repeat(np.arange(len(reps)), n)
                for c, name in zip(cols, ("key", "lo", "hi")):
                    c.append(np.array([r[name] for r in reps], np.int64)[of])
                cols[3].append((starts - first[of]).astype(np.int32))
                cols[4].extend(_digests(codes, starts, starts + width))
                cols[5].extend([reps[k]["whole"] for k in of])
            arrays = [pa.array(np.concatenate(c)) for c in cols[:4]] + [pa.array(c, pa.binary()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "lo", "hi", "at", "print", "whole"])

    return texts.mapInArrow(rows, "key long, lo long, hi long, at int, print binary, whole binary")


def _single(texts: DataFrame) -> DataFrame:
    """One text for each id: the greatest of those that repeat one. Only these are shuffled."""
    many, _ = cut(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "repeated")
    if many.isEmpty():
        return texts
    return texts.join(many, "doc_id", "left_anti").unionByName(texts.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def shared_spans(docs: DataFrame, width: int = 150) -> DataFrame:
    """``doc_id, start, end``: runs of windows of ``width`` characters that stand unchanged in another document, too.

    1. Every text is cut into tokens, and these are recompressed; each of a text's windows has one symbol whose ground lies in it, and windows in a row
       with the same symbol make one row (a row stands for some fifty characters).
    2. Symbols that occur in at least two documents are kept. Counting combines before the shuffle; only
       the rows of kept symbols go on, a small part of the text.
    3. Rows with the same symbol and the same characters (by a cryptographic digest of them) are one variant. A variant in two documents is shared whole.
    4. Where a symbol has several variants, passages begin or end, or only the symbol is the same: there the windows of
       one copy of each variant are taken from the text again and compared, by digests of all their characters.

    So equal symbols only bring windows together; what is said to be shared has equal characters (to 128-bit digests). No pair of documents is ever formed, and there is no limit
    on copies: a passage in a third of all documents is one variant. Passages repeated inside one document only do not count.
    Null texts, null ids and texts shorter than ``width`` give no row. Characters are code points. Of rows that repeat an id one counts, that of the greatest text.
    """
    texts = docs.where("doc_id is not null").where(F.length("text") >= width).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = _single(texts)
    rows, rows_at = cut(_symbol_rows(texts, width), "rows")
    two = F.min("doc_id") != F.max("doc_id")
    keys, _ = cut(rows.groupBy("key").agg(two.alias("two")).where("two").select("key"), "keys")
    found, _ = cut(rows.join(keys, "key", "left_semi"), "found")
    forget(docs.sparkSession, rows_at)
    variants = found.groupBy("key", "whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("n").alias("n"), F.min(F.struct("doc_id", "first")).alias("at"))
    variants, _ = cut(variants, "variants")
    several = variants.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    reps = variants.join(several, "key", "left_semi")
    lists = reps.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("key", "whole", "lo", "hi", F.col("at.first").alias("first"), "n")).alias("reps"))
    lists, _ = cut(lists, "reps")
    windows, _ = cut(_window_digests(texts.join(lists, "doc_id").select("text", "reps"), width), "windows")
    common = windows.groupBy("key", "print").agg((F.min("lo") != F.max("hi")).alias("two")).where("two").select("key", "print")
    by_window = windows.join(common, ["key", "print"], "left_semi").groupBy("key", "whole").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # windows in a row become one span
    begins = F.filter("ats", lambda x, k: (k == 0) | (F.get("ats", k - 1) != x - 1))
    ends = F.filter("ats", lambda x, k: (k == F.size("ats") - 1) | (F.get("ats", k + 1) != x + 1))
    by_window = by_window.select("key", "whole", F.arrays_zip(begins.alias("a"), ends.alias("b")).alias("runs"))
    whole = variants.where("lo <> hi").select("key", "whole", F.lit(None).cast("array<struct<a: int, b: int>>").alias("runs"))
    shared = whole.unionByName(by_window.join(whole.select("key", "whole"), ["key", "whole"], "left_anti"))
    met = found.join(shared, ["key", "whole"])
    full = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    each = met.select("doc_id", "first", F.explode(F.coalesce("runs", full)).alias("r"))
    return each.select("doc_id", (F.col("first") + F.col("r.a")).alias("start"), (F.col("first") + F.col("r.b") + width).alias("end"))


def shared_lengths(docs: DataFrame, width: int = 150) -> DataFrame:
    """``doc_id, shared_chars``: how many characters of each document lie in a span shared with another; only above 0."""
    spans = shared_spans(docs, width)
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("seen", F.coalesce(F.max("end").over(w), F.lit(0)))
    got = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))
    return new.groupBy("doc_id").agg(F.sum(got).cast("long").alias("shared_chars")).where("shared_chars > 0")
