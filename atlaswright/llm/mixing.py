"""Mixing sources to target weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaswright.functions.readings import source_reading
from atlaswright.llm.tokens import TOKENIZER, count_tokens
from atlaswright.session import cut


@dataclass
class Mixture:
    """``drawn(shard, slot, source, use, doc_id, from_token, to_token, n_tokens)`` and ``report``, one row for each listed source."""

    drawn: DataFrame
    report: DataFrame


def permuted(index, n: int, key: int):  # noqa: ANN001, ANN201
    """A pseudorandom permutation of 0..n-1 applied to an array: a four-round Feistel cipher, walked until it lands below n."""
    import numpy as np

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
            f = (right + salt) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(17)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype("int64")


def split_counts(counts: list[int], take: int, key: list[int]) -> list[int]:
    """How many of ``take`` draws without replacement from an urn of ``counts`` are of each kind, from a seed of its own."""
    import numpy as np

    rng, left, out = np.random.default_rng(key), sum(counts), []
    for c in counts:
        rest = left - c
        if left >= 10**9:  # beyond what the exact sampler takes: the normal limit, kept within what is possible
            mean = take * c / left
            k = round(rng.normal(mean, (mean * (rest / left) * (left - take) / (left - 1)) ** 0.5))
            k = min(max(k, take - rest, 0), c, take)
        else:
            k = int(rng.hypergeometric(c, rest, take))
        out.append(k)
        take, left = take - k, rest
    return out


def shard_counts(shard: int, shards: int, per_shard: int, due: list[int], seed: int) -> tuple[list[int], list[int]]:
    """(counts, first slots) of each source in one output shard.

    Multinomial draws of all shards, given that they add up to what is due of each source: the due counts are split in two
    again and again, down to single shards. A shard follows its own branch, so it needs no other shard's draw.
    """
    lo, hi, first = 0, shards, [0] * len(due)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_counts(due, min(sum(due), (mid - lo) * per_shard), [seed, lo, hi])
        if shard < mid:
            due, hi = left, mid
        else:
            first = [f + k for f, k in zip(first, left)]
            due, lo = [d - k for d, k in zip(due, left)], mid
    return due, first


def _due(tokens: int, target: float, most: int, block: int) -> int:
    """Slots of a source: whole passes through its blocks, then as many full blocks as come nearest to the target."""
    if not tokens or not most:
        return 0
    blocks = -(-tokens // block)
    passes = min(int(target // tokens), most)
    slots, rest = passes * blocks, target - passes * tokens
    if passes < most and rest > 0:
        some = min(round(rest / block), blocks - 1)
        # the pass as a whole, with its shorter last block, may come nearer
        slots += blocks if abs(tokens - rest) < abs(some * block - rest) else some
    return slots


def mix_sources(docs: DataFrame, targets: DataFrame, block_tokens: int = 2048, per_shard: int = 512, per_bucket: int = 20_000, seed: int = 7, tokenizer: str = TOKENIZER) -> Mixture:
    """Draw tokens so that each listed source has its ``target_share`` of as many tokens as all its documents have together.

    Within each source, documents stand one after the other in hashed order, and their tokens are cut into blocks of exactly
    ``block_tokens`` (only a source's last block is shorter): a block goes across documents, and a drawn row is the part [from_token, to_token) of
    a document that lies in a drawn block. Every output shard has a multinomial draw of how many of its ``per_shard`` slots each source gets, given
    what is due of each source in all. A source's slots go, pass after pass, through
    a pseudorandom permutation of its full blocks and then its last one; the block numbers are joined with the parts. So a source that can reach
    its target is within half a block of it, at any scale.

    No block is drawn more than ``max_repeats`` times, hence no token is: a source that
    cannot reach its share (tokens * max_repeats < target_share * all tokens) is used up, as often as allowed, and
    reported as ``exhausted`` and not ``reachable``; the others still get their due of the intended total. Then the drawn total is smaller than
    intended: ``share_of_intended`` is the share of all tokens of listed sources, ``drawn_share`` that of the drawn ones.

    ``targets`` is a parameter table (a row for each source), read by the driver with one sum of tokens for each; documents, tokens and slots stay
    distributed. Documents are placed by running sums of buckets (ranges of the hash, about ``per_bucket`` documents each, as many as the source
    needs), of a thousand buckets together, and inside a bucket. ``source`` counts without outer blanks and in lower case.
    Documents of no listed source, without id or without tokens are not drawn; a null share is 0, null or negative ``max_repeats`` 0;
    a source listed twice counts once, with its largest values.
    """
    spark: SparkSession = docs.sparkSession
    wanted = targets.select(source_reading(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))).cast("long").alias("most"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    listed = sorted(tuple(r) for r in wanted.collect())
    names = [s for s, _, _ in listed]
    read = docs.where("doc_id is not null").withColumn("__source", source_reading(F.col("source"))).where(F.col("__source").isin(names)).select("doc_id", "text", F.col("__source").alias("source"))
    counts, _ = cut(count_tokens(read, keep=["source"], tokenizer=tokenizer).where("n_tokens > 0"), "tokens")
    have = {r["source"]: (r["t"], r["n"]) for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    tokens = {s: have.get(s, (0, 0))[0] for s in names}
    total = sum(tokens.values())
    blocks = {s: -(-tokens[s] // block_tokens) for s in names}
    due = {s: _due(tokens[s], share * total, most, block_tokens) for s, share, most in listed}
    shards = -(-sum(due.values()) // per_shard)
    facts = [(s, float(share), most, tokens[s], total, due[s], max(1, have.get(s, (0, 0))[1] // per_bucket)) for s, share, most in listed]
    facts = spark.createDataFrame(facts, "source string, target_share double, max_repeats long, tokens long, total long, due long, buckets long")

    # documents to tokens: running sums of a thousand buckets, of buckets and inside a bucket
    placed = counts.join(F.broadcast(facts.select("source", "buckets")), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))  # a row for each listed source
    placed = placed.withColumn("bucket", F.least(F.col("buckets") - 1, F.floor((F.shiftrightunsigned("h", 1) / float(1 << 63)) * F.col("buckets"))).cast("long"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("above", F.floor(F.col("bucket") / 1000))
    ahead = lambda by, order: F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy("source", "above").agg(F.sum("t").alias("t")).withColumn("t0", ahead(["source"], ["above"])).drop("t")
    sums = sums.withColumn("t1", ahead(["source", "above"], ["bucket"])).join(tops, ["source", "above"]).select("source", "bucket", (F.col("t0") + F.col("t1")).alias("start"))
    order = [F.shiftrightunsigned("h", 1), "doc_id", "n_tokens"]
    placed = placed.withColumnRenamed("n_tokens", "t").withColumn("n_tokens", F.col("t")).withColumn("ahead", ahead(["source", "bucket"], order)).join(sums, ["source", "bucket"])
    at = placed.select("source", "doc_id", "n_tokens", (F.col("start") + F.col("ahead")).alias("at"))
    cuts = F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("n_tokens") - 1) / block_tokens))
    parts = at.withColumn("block", F.explode(cuts))
    start = F.greatest(F.lit(0).cast("long"), F.col("block") * block_tokens - F.col("at"))
    end = F.least(F.col("n_tokens"), (F.col("block") + 1) * block_tokens - F.col("at"))
    parts = parts.select("source", "block", "doc_id", start.alias("from_token"), end.alias("to_token"))

    chosen = _chosen(spark, shards, per_shard, [(s, due[s], blocks[s]) for s in names if due[s]], seed)
    # the slots are far more than the size of the shards' numbers suggests, so they must not be taken for a side to broadcast
    drawn = chosen.join(parts.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "use", "doc_id", "from_token", "to_token", (F.col("to_token") - F.col("from_token")).alias("n_tokens"))

    sums = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("use").alias("uses"))
    report = facts.join(sums, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0))).withColumn("all", F.sum("drawn_tokens").over(Window.partitionBy()))
    target = F.col("target_share") * F.col("total")
    share = lambda of: F.when(F.col(of) > 0, F.col("drawn_tokens") / F.col(of))
    report = report.select(
        "source", "target_share", "max_repeats", "tokens", target.alias("target_tokens"), "drawn_tokens", share("total").alias("share_of_intended"), share("all").alias("drawn_share"),
        F.coalesce("uses", F.lit(0)).alias("uses"), (F.col("drawn_tokens") >= F.col("tokens") * F.col("max_repeats")).alias("exhausted"), (F.col("tokens") * F.col("max_repeats") >= target).alias("reachable"),
    )
    return Mixture(drawn, report)


def _chosen(spark: SparkSession, shards: int, per_shard: int, sources: list[tuple[str, int, int]], seed: int) -> DataFrame:
    """``shard, slot, source, use, block``: each shard's slots; ``slot`` numbers a source's draws."""

    def choose(batches: Iterator):  # noqa: ANN202
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for shard in pdf["id"]:
                counts, first = shard_counts(int(shard), shards, per_shard, [d for _, d, _ in sources], seed)
                out = []
                for (s, _, n), c, f in zip(sources, counts, first):
                    slot = np.arange(f, f + c)
                    use, at = slot // n, slot % n
                    for u in np.unique(use):
                        # the last block, which may be shorter, closes each pass
                        full = (use == u) & (at < n - 1)
                        at[full] = permuted(at[full], n - 1, zlib.crc32(f"{seed}/{s}/{u}".encode()))
                    out.append(pd.DataFrame({"shard": int(shard), "slot": slot, "source": s, "use": use + 1, "block": at}))
                yield pd.concat(out)

    schema = "shard long, slot long, source string, use long, block long"
    if not shards:
        return spark.createDataFrame([], schema)
    return spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(choose, schema)
