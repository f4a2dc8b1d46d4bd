"""Packing, mixing and shared spans."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlaswright.llm import shared_spans as S
from atlaswright.llm.mixing import _due, mix_sources, permuted, shard_counts, split_counts
from atlaswright.llm.packing import best_fit_decreasing, container_report, pack_documents
from atlaswright.llm.tokens import PATTERN, TOKENIZER, count_tokens, pieces

DOCS = "doc_id bigint, text string, source string"


def plain_best_fit(sizes, capacity):
    left, where = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        fits = [b for b in range(len(left)) if left[b] >= sizes[k]]
        b = min(fits, key=lambda x: left[x], default=None)
        if b is None:
            b = len(left)
            left.append(capacity)
        left[b] -= sizes[k]
        where[k] = b
    return where, len(left)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit(case):
    capacity, sizes = case
    where, n = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(where, weights=sizes, minlength=n) if sizes else np.zeros(0)
    assert n == plain_best_fit(sizes, capacity)[1] and (fill <= capacity).all() and len(fill) == n


def test_counts_equal_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "a", " Ein  Satz,\n\nmit 12345 Zahlen's ", "x" * 5000, "<|endoftext|>", "ünïcödé 漢字 😀", None]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert got == {k: len(enc.encode_ordinary(t or "")) for k, t in enumerate(texts)}


def test_packing(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "Gamma12", "x,"]) for _ in range(r.choice([0, 3, 40, 90, 700]))), "s") for k in range(120)]
    rows += [(900, None, None), (901, "", None), (None, "text", None)]
    df = spark.createDataFrame(rows, DOCS)
    n = {k: pieces(TOKENIZER).count(t) for k, t, _ in rows}
    for shard in (10**9, 3000):
        packed = pack_documents(df, 128, shard)
        got = packed.collect()
        by, fill = {}, {}
        for x in got:
            by.setdefault(x.doc_id, []).append((x.part, x.n_tokens))
            fill[x.container] = fill.get(x.container, 0) + x.n_tokens
            assert x.is_split == (n[x.doc_id] > 128)
        assert {k: sum(t for _, t in v) for k, v in by.items()} == {k: v for k, v in n.items() if v and k is not None}
        assert all(sorted(p for p, _ in v) == list(range(len(v))) and (len(v) == 1) == (n[k] <= 128) for k, v in by.items())
        assert max(fill.values()) <= 128
        rep = container_report(packed, 128).first()
        assert rep.containers == len(fill) and rep.tokens == sum(fill.values())
        if shard > 10**6:
            assert rep.containers <= 1.05 * rep.least_containers + 1
    assert container_report(pack_documents(df.limit(0), 128)).first().containers == 0


@pytest.mark.parametrize("text", [" word" * 50, "x" * 900 + " Satz " + "漢字😀" * 40, "a  b \n\n c" * 30])
def test_cuts(text):
    p = pieces(TOKENIZER)
    parts = p.cuts(text, 8)
    assert [a for a, _, _ in parts] == [0, *[b for _, b, _ in parts][:-1]] and parts[-1][1] == len(text)
    assert all(p.count(text[a:b]) <= 8 and n <= 8 for a, b, n in parts)


def test_parts_are_the_text(spark):
    text = "y" * 3000 + " Ein Satz mit Wörtern." * 90
    got = pack_documents(spark.createDataFrame([(1, text, None), (2, "short", None)], DOCS), 64).orderBy("doc_id", "part").collect()
    assert "".join(text[x.start : x.end] for x in got if x.doc_id == 1) == text and [(x.start, x.end) for x in got if x.doc_id == 2] == [(0, 5)]
    assert all(pieces(TOKENIZER).count(text[x.start : x.end]) <= 64 for x in got if x.doc_id == 1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 5)) == list(range(n))


def test_mixing(spark):
    r = random.Random(6)
    rows = [(k, " word" * r.randint(5, 60), r.choice([" Alpha ", "alpha", "ALPHA"]) if k % 10 < 6 else "beta" if k % 10 < 9 else "gamma") for k in range(1200)]
    rows += [(5000, " word" * 900, "unlisted"), (5001, " word", None), (5002, None, "beta"), (5003, "", "beta")]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("alpha", 0.3, 1), ("beta", 0.4, 3), ("gamma", 0.3, 2), ("nothing", 0.0, 1), (None, 0.5, 1), ("empty", 0.1, None)], "source string, target_share double, max_repeats int")
    mix = mix_sources(df, targets, block_tokens=256, per_shard=16, per_bucket=7)
    rep = {x.source: x for x in mix.report.collect()}
    total = sum(rep[s].tokens for s in ("alpha", "beta", "gamma"))
    assert total == sum(pieces(TOKENIZER).count(t) for k, t, s in rows if k < 5000)
    assert rep["alpha"].reachable and rep["beta"].reachable and not rep["gamma"].reachable and rep["nothing"].reachable and not rep["empty"].reachable
    for s in ("alpha", "beta"):
        assert abs(rep[s].drawn_tokens - rep[s].target_tokens) <= 128 and abs(rep[s].share_of_intended - rep[s].target_share) <= 128 / total
    assert rep["gamma"].drawn_tokens == 2 * rep["gamma"].tokens and rep["gamma"].exhausted and not rep["alpha"].exhausted
    drawn = mix.drawn.collect()
    most, token = {"alpha": 1, "beta": 3, "gamma": 2}, {}
    for x in drawn:
        for k in range(x.from_token, x.to_token):
            token[x.source, x.doc_id, k] = token.get((x.source, x.doc_id, k), 0) + 1
    assert all(n <= most[s] for (s, *_), n in token.items())
    fill = {}
    for x in drawn:
        fill[x.source, x.slot] = fill.get((x.source, x.slot), 0) + x.n_tokens
    assert {v for (s, _), v in fill.items() if s == "alpha"} == {256} and max(fill.values()) == 256
    slots = {}
    for s, k, h in {(x.source, x.slot, x.shard) for x in drawn}:
        slots[h] = slots.get(h, 0) + 1
        assert h < -(-len(fill) // 16)
    assert sorted(slots.values())[1:] == [16] * (len(slots) - 1)
    again = mix_sources(df.repartition(7), targets, block_tokens=256, per_shard=16, per_bucket=7).drawn
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.drawn.collect()))
    nothing = mix_sources(df.limit(0), targets)
    assert nothing.drawn.count() == 0 and nothing.report.count() == 5


def test_due_slots():
    for tokens, target, most in ((1000, 250.0, 1), (1000, 999.0, 1), (1000, 2490.0, 3), (70, 300.0, 9), (1000, 5000.0, 2), (0, 5.0, 2), (10, 0.0, 2)):
        n = -(-tokens // 100)
        due = _due(tokens, target, most, 100)
        got = due // n * tokens + due % n * 100 if n else 0
        assert got <= tokens * most and (got == tokens * most or abs(got - target) <= 50)


def test_shard_counts_add_up():
    due = [700, 0, 41, 3]
    got = [shard_counts(k, 12, 64, due, 5) for k in range(12)]
    assert [sum(c[j] for c, _ in got) for j in range(4)] == due and [sum(c) for c, _ in got][:-1] == [64] * 11
    assert all([f[j] + c[j] for j in range(4)] == g[1][:4] for (c, f), g in zip(got, got[1:]))
    big = split_counts([3 * 10**9, 10**9], 10**9, [1])
    assert sum(big) == 10**9 and abs(big[0] - 75 * 10**7) < 10**6


def brute_shared(docs, width):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - width + 1):
            where.setdefault(t[i : i + width], set()).add(d)
    out = {}
    for d, t in docs:
        mark = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - width + 1):
            if len(where[t[i : i + width]]) > 1:
                mark[i : i + width] = True
        if mark.any():
            out[d] = int(mark.sum())
    return out


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢😀") for _ in range(r.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(r.randint(5, 60)) for _ in range(6)] + ["ab" * 90, "-" * 170, "abc" * 20]
    docs = []
    for d in range(n):
        parts = [prose(r.randint(0, 40)) for _ in range(3)] + r.sample(shared, r.randint(0, 3))
        r.shuffle(parts)
        docs.append((d, r.choice(["", " ", "\n"]).join(parts)))
    docs += [(n, shared[0] * 3), (n + 1, docs[0][1]), (n + 2, docs[0][1]), (n + 3, "z" * 400), (n + 4, "z" * 200 + "y"), (n + 5, None), (n + 6, ""), (n + 7, "q" * 400 + prose(3) + "q" * 400)]
    return docs


@pytest.mark.parametrize(("width", "piece"), [(60, 400_000), (60, 150), (150, 1000)])
def test_shared_lengths(spark, monkeypatch, width, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    docs = corpus(width + piece, 40)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs] + [(None, "z" * 400, 1, "x")], "doc_id bigint, text string, start int, `end` string")
    got = {r.doc_id: r.shared_chars for r in S.shared_lengths(df, width).collect()}
    assert got == brute_shared(docs, width)


def test_every_window_has_one_row():
    docs = [t for _, t in corpus(3, 30) if t]
    key, text, first, n, _ = S.window_rows(docs, 60)
    seen = [np.zeros(max(0, len(t) - 59), int) for t in docs]
    for k, f, m in zip(text, first, n):
        seen[k][f : f + m] += 1
    assert all((s == 1).all() for s in seen)


def test_same_window_same_key():
    docs = [t for _, t in corpus(5, 30) if t]
    key, text, first, n, _ = S.window_rows(docs, 60)
    keys = {}
    for q, k, f, m in zip(key, text, first, n):
        for i in range(f, f + m):
            keys.setdefault(docs[k][i : i + 60], set()).add(int(q))
    assert all(len(v) == 1 for v in keys.values())


def test_no_shared_text(spark):
    assert S.shared_lengths(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_that_repeat(spark):
    long = " ".join(str(k) for k in range(99))
    df = spark.createDataFrame([(1, long, None), (1, "a", None), (1, "z" * 200, None), (2, long, None), (3, "z" * 180, None)], DOCS)
    assert {r.doc_id: r.shared_chars for r in S.shared_lengths(df).collect()} == {1: 200, 3: 180}


def test_texts_that_sums_of_powers_confuse(spark):
    """A Thue-Morse text and its complement differ everywhere, though polynomial sums modulo a power of two do not tell them apart."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a, None), (2, b, None)], DOCS)
    assert {r.doc_id: r.shared_chars for r in S.shared_lengths(df, 2048).collect()} == brute_shared([(1, a), (2, b)], 2048)
