"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES = [1 - 0.5**k for k in range(1, 14)]  # shares of a group's rows below each step's lower edge


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, salts: int = 16) -> DataFrame:
    """``group, item, score, rank``: the ``n`` items of the highest score in every group, ties by the smaller item.

    Groups of more than ``4 * n + 64`` rows are pruned first. Their scores go into a histogram whose steps hold a half, a quarter, an eighth, ... of
    the group's rows from below (edges from a sketch), so one outlier does not spoil it. Each step keeps, besides, a bit for each
    of 4 n hash slots that an item of it falls into: the slots met in a step and those above it are a lower bound of the *distinct* items
    there, however often items repeat. The highest step with at least n gives the threshold: rows below it cannot be among the first n, and go
    before anything else. Counting combines before the shuffle, on the scanned rows; only what is left is shuffled by item (repeated
    items keep their highest score) and ranked exactly. Rows meet their group's threshold on (group, salt), so a group with a
    third of all rows is spread over tasks. If that many rows tie at the threshold, all go on to the ranking, whose
    partial limit keeps n of each task.

    Null groups, items or scores and NaN scores do not count.
    """
    g, i, s = F.col(group), F.col(item), F.col(score).cast("double")
    usable = rows.where(g.isNotNull() & i.isNotNull() & s.isNotNull() & ~F.isnan(s)).select(g.alias("g"), i.alias("i"), s.alias("s"))
    salted = usable.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    large = usable.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 4 * n + 64).select("g")
    spread = large.withColumn("salt", every)
    # sketches of single salts are merged, so no group goes through one task
    edges = salted.join(spread, ["g", "salt"], "left_semi").groupBy("g").agg(F.percentile_approx("s", EDGES, 10_000).alias("edges"))
    words = -(-4 * n // 64)
    slot = F.pmod(F.xxhash64("i", F.lit(1)), F.lit(64 * words))
    bits = [F.bit_or(F.when(F.floor(slot / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(words)]
    step = F.size(F.filter("edges", lambda e: e <= F.col("s")))
    hist = salted.join(edges.withColumn("salt", every), ["g", "salt"]).groupBy("g", "edges", step.alias("step")).agg(*bits)
    above = Window.partitionBy("g").orderBy(F.desc("step"))  # at most a row for each edge
    held = hist.select("g", "edges", "step", *[F.bit_or(f"b{w}").over(above).alias(f"b{w}") for w in range(words)])
    distinct = sum((F.bit_count(f"b{w}") for w in range(words)), F.lit(0))
    floors = held.where((distinct >= n) & (F.col("step") > 0)).groupBy("g").agg(F.max(F.get("edges", F.col("step") - 1)).alias("floor"))
    kept = salted.join(floors.withColumn("salt", every), ["g", "salt"], "left").where(F.col("floor").isNull() | (F.col("s") >= F.col("floor")))
    once = kept.groupBy("g", "i").agg(F.max("s").alias("s"))
    best = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    ranked = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def kept_neighbors(neighbors: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """``title, neighbor, score, rank``: the n best neighbours; scores below ``least`` and a title beside itself do not count."""
    return top_n(neighbors.where((F.col("title") != F.col("neighbor")) & (F.col("score") >= least)), "title", "neighbor", "score", n)
