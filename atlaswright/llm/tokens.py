"""Token counts of whole texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the tokenizer's own split into pieces (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KEPT = 200_000


class Pieces(dict):
    """Token count of each piece; merges never cross pieces, so a text's count is the sum over its pieces."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        n = len(self._encode(piece))
        if len(self) < _KEPT and len(piece) < 40:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.split(text))) if text else 0

    def cuts(self, text: str, size: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of parts of at most ``size`` tokens, in characters, cut at piece ends; a piece of more is cut at its tokens."""
        out, begin, used, at = [], 0, 0, 0
        for piece in self.split(text):
            n = self[piece]
            if used and used + n > size:
                out.append((begin, at, used))
                begin, used = at, 0
            if n > size:
                for length, k in self._broken(piece, size):
                    out.append((at, at + length, k))
                    at += length
                begin = at
            else:
                used, at = used + n, at + len(piece)
        if at > begin:
            out.append((begin, at, used))
        return out

    def _broken(self, piece: str, size: int) -> Iterator[tuple[int, int]]:
        """(characters, tokens) of the parts of one long piece; a part's count is that of its own tokens."""
        at = 0
        while at < len(piece):
            low, high = 1, min(len(piece) - at, size * self._longest)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if len(self._encode(piece[at : at + mid])) <= size else (low, mid - 1)
            yield low, len(self._encode(piece[at : at + low]))
            at += low


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The tokenizer, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, tokenizer: str = TOKENIZER, size: int | None = None) -> DataFrame:
    """``id, (kept columns,) n_tokens`` of every row; a null or empty text has 0 tokens.

    With ``size`` also ``parts``: start, end (characters) and tokens of the parts of at most so many tokens that a text of more is cut into,
    null for others. Arrow batches pass through Python once; only the counts come back. Special tokens' strings are ordinary text.
    """
    import pyarrow as pa

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    kept = [id_col, *(keep or [])]
    fields = [docs.schema[c] for c in kept] + [StructField("n_tokens", LongType())]
    part = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32())])
    if size:
        fields.append(StructField("parts", ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "end", "tokens")]))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(tokenizer)
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            n = [p.count(t) for t in texts]
            cols, names = [*(b.column(k) for k in range(len(kept))), pa.array(n, pa.int64())], [*kept, "n_tokens"]
            if size:
                parts = [[dict(zip(("start", "end", "tokens"), x)) for x in p.cuts(t, size)] if k > size else None for t, k in zip(texts, n)]
                cols.append(pa.array(parts, pa.list_(part)))
                names.append("parts")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*kept, text).mapInArrow(counted, StructType(fields))
