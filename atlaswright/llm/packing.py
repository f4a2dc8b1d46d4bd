"""Filling fixed-capacity containers with texts of varying length."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaswright.llm.tokens import TOKENIZER, count_tokens
from atlaswright.session import cut


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size and the number of bins.

    Items go, largest first, into the open bin that they fill most tightly. Open bins are kept by their
    remaining capacity in a segment tree over 0..capacity whose nodes say whether any bin below has
    that much left: the tightest fitting bin is found on one way up and down the tree.
    Sizes must be between 1 and ``capacity``.
    """
    width = 1
    while width <= capacity:
        width *= 2
    count = [0] * (2 * width)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, opened = [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        need = sizes[k]
        node = width + need
        if not count[node]:
            # up to the first subtree to the right that holds an open bin, then down to its leftmost leaf
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while node and node < width:
                node *= 2
                if not count[node]:
                    node += 1
        if node:
            left = node - width
            b = bins[left].pop()
            step, change = node, -1
            while step:
                count[step] += change
                step >>= 1
        else:
            left, b, opened = capacity, opened, opened + 1
        where[k] = b
        left -= need
        if left:
            bins[left].append(b)
            step = width + left
            while step:
                count[step] += 1
                step >>= 1
    return where, opened


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_tokens: int = 16_000_000, tokenizer: str = TOKENIZER) -> DataFrame:
    """``container, doc_id, part, start, end, n_tokens, is_split``: every text in containers of ``capacity`` tokens.

    A text longer than a container is cut, at the ends of the tokenizer's pieces where that goes, into parts that nearly fill one each and a rest
    (numbered by ``part``); no other text is split. ``start`` and ``end`` are a row's characters (code points) in its text: a text's parts in order
    are the text. Parts and texts are packed best-fit decreasing, in shards of about ``shard_tokens`` tokens: a shard is filled with
    thousands of containers, so closing its last ones costs next to nothing, and no task ever holds
    more than a shard's lengths. Shards are hashes of ``doc_id`` and ``part``, so a task that runs again gives the same result, and
    a text of any length spreads. Texts are read once; lengths and offsets are written to the scratch folder.

    Null and empty texts, of 0 tokens, take no container and give no row. Texts that occur under
    several ids are packed each; rows with a null id are dropped. Rows that repeat an id are packed each, like different texts.
    """
    read = docs.where("doc_id is not null").select("doc_id", "text", F.length("text").alias("chars"))
    counts, _ = cut(count_tokens(read, keep=["chars"], tokenizer=tokenizer, size=capacity).where("n_tokens > 0"), "tokens")
    shards = max(1, round((counts.agg(F.sum("n_tokens")).first()[0] or 0) / shard_tokens))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("chars").alias("end"), F.col("n_tokens").cast("int").alias("tokens")))
    items = counts.select("doc_id", F.col("parts").isNotNull().alias("is_split"), F.posexplode(F.coalesce("parts", whole)).alias("part", "p"))
    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")
    items = items.select(shard.alias("shard"), "doc_id", "part", "p.start", "p.end", F.col("p.tokens").cast("long").alias("n_tokens"), "is_split")

    def packed(_, pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["doc_id", "part", "end"], kind="stable")
        where, _ = best_fit_decreasing(pdf["n_tokens"].tolist(), capacity)
        pdf["container"] = [f"{s}-{b}" for s, b in zip(pdf["shard"], where)]
        return pdf[["container", "doc_id", "part", "start", "end", "n_tokens", "is_split"]]

    return items.groupBy("shard").applyInPandas(packed, "container string, doc_id bigint, part int, start int, end int, n_tokens bigint, is_split boolean")


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, lower bound of containers and the share of used space."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("items"))
    total = by.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("used_share"))
