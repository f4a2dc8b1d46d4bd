"""One ranking from several differently-scaled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.session import cut, forget

MAD_TO_SD = 1.4826  # standard deviations in a median absolute deviation, for normal data
MEAN_TO_SD = 1.2533  # the same for a mean absolute deviation
MARGIN = 0.001  # of a group's rows on either side of the middle that are ordered exactly
SKETCH = 10_000  # inverse of the rank error of the sketches that say where the middle lies
PLACES = 12  # fused values equal to so many places are a tie


def _brackets(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``g, salts, n_, lo_, hi_ (of each column)``: values between which each group's median lies, from sketches of bounded size."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        at = F.percentile_approx(c, [0.5 - MARGIN, 0.5 + MARGIN], SKETCH)
        aggs += [F.count(c).alias(f"n_{c}"), at[0].alias(f"lo_{c}"), at[1].alias(f"hi_{c}")]
    return rows.groupBy("g").agg(*aggs).withColumn("salts", F.ceil(F.col("__n") / most)).drop("__n")


def _spread(groups: DataFrame) -> DataFrame:
    """A row of each group for each of its salts."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")


def exact_medians(rows: DataFrame, columns: list[str], brackets: DataFrame) -> DataFrame:
    """``g, m_ (of each column)``: exact medians of each group; ``rows``: g, salt and the columns, in which nulls do not count.

    Rows meet their group's brackets on (group, salt). Values below a bracket are only counted (before the shuffle), values above it go, and the
    values inside, a five-hundredth of a group, are ordered. A group with a third of all rows is never ordered as a whole,
    whatever its values: brackets go by rank, not by value. Where a sketch missed the middle (its error is bounded, so none should), the
    group's values are ordered whole.
    """
    spark = rows.sparkSession
    met = rows.join(_spread(brackets), ["g", "salt"])

    def entry(k: int, c: str) -> Column:
        v = F.col(c)
        side = F.when(v < F.col(f"lo_{c}"), F.struct(F.lit(k).alias("k"), F.col(f"n_{c}").alias("n"), F.lit(0).alias("in"), F.lit(None).cast("double").alias("v")))
        return side.when(v <= F.col(f"hi_{c}"), F.struct(F.lit(k).alias("k"), F.col(f"n_{c}").alias("n"), F.lit(1).alias("in"), v.alias("v")))

    def middles(entries: DataFrame) -> DataFrame:
        c = entries.groupBy("g", "e.k", "e.n", "e.in", "e.v").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("g", "k").orderBy("in", "v"))
        c = c.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("c")).where("in = 1")
        lo, hi = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
        at = lambda r: F.max(F.when((r > F.col("start")) & (r <= F.col("upto")), F.col("v")))
        mid = (at(lo) + at(hi)) / 2
        return c.groupBy("g", "k").agg(F.max("n").alias("n"), mid.alias("m"))

    one = met.select("g", F.explode(F.array_compact(F.array(*[entry(k, c) for k, c in enumerate(columns)]))).alias("e"))
    long, _ = cut(middles(one).where("m is not null"), "medians")
    due = brackets.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n_{c}").alias("n")) for k, c in enumerate(columns)])).alias("e"))
    missed = due.where("e.n > 0").select("g", "e.k").join(long, ["g", "k"], "left_anti")
    if not missed.isEmpty():
        every = rows.join(_spread(brackets).select("g", "salt", *[f"n_{c}" for c in columns]), ["g", "salt"])
        every = every.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n_{c}").alias("n"), F.lit(1).alias("in"), F.col(c).alias("v")) for k, c in enumerate(columns)])).alias("e"))
        every = every.where("e.v is not null").join(missed.select("g", F.col("k").alias("__k")), "g").where("e.k = __k")
        long, _ = cut(long.unionByName(middles(every)), "medians")
    return long.groupBy("g").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"m_{c}") for k, c in enumerate(columns)])


def _rank(scored: DataFrame) -> DataFrame:
    """Ranks of whole groups: all rows are range-partitioned in rank order, so a group of any size, of any values, spreads over many tasks.

    A row's rank is its place in its partition, less those of other groups before it, plus its group's rows in earlier partitions.
    """
    spark = scored.sparkSession
    scored, _ = cut(scored, "scored")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col("g"), F.desc("key"), F.desc("second"), F.col("i")]
    ranged = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    ranged, _ = cut(ranged, "ranged")
    heads = ranged.groupBy("g", "p").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    heads = heads.select("g", "p", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    return ranged.join(heads, ["g", "p"]).withColumn("rank", F.col("before") + F.col("m") - F.col("first") + 1)


def fuse_scores(rows: DataFrame, group: str, item: str, scores: dict[str, float], keep: int | None = None, most: int = 20_000) -> DataFrame:
    """``group, item, fused, rank``: each group's items in one order by several scores together.

    Every score is standardised within its group by median and median absolute deviation (where
    that is 0, by the mean absolute deviation; where all values agree, to 0), squashed by the logistic
    function, so that no outlier counts for more than 1, and the squashed values are combined by a
    geometric mean weighted with ``scores``. ``fused`` is that mean's logarithm, which keeps apart
    what the mean itself would round to 1. Values equal to twelve places are a tie, so the order of the rows decides nothing.
    Ties: higher sum of standardised scores (to twelve places, too), then the smaller item.

    A null or NaN score ranks below any number: an item's number of missing scores (weighted) comes
    before anything else would, as its squashed value is below that of every number. Equal rows count once; several
    rows of one item keep that item's highest fused value. Rows with a null group or item, or an item that is its
    own group, do not count. With ``keep``, only the first ``keep`` of each group are ranked and returned (each task
    keeps no more); without it whole groups are, in range partitions. Groups of more than ``most`` rows spread over several tasks.
    """
    total = sum(scores.values())
    if total <= 0 or min(scores.values()) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    spark = rows.sparkSession
    xs = [f"x{k}" for k in range(len(scores))]
    ds = [f"d{k}" for k in range(len(scores))]
    base = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(x) for x, c in zip(xs, scores)])
    base, base_at = cut(base.where("g is not null and i is not null and g <> i").distinct(), "base")
    near, _ = cut(_brackets(base, xs, most), "near")
    salt = F.pmod(F.xxhash64("i"), F.coalesce("salts", F.lit(1)))
    salted = base.join(near.where("salts > 1").select("g", "salts"), "g", "left").withColumn("salt", salt).drop("salts")
    med = near.select("g", "salts").join(exact_medians(salted, xs, near), "g", "left")
    med, _ = cut(med, "middle")

    away = salted.join(_spread(med), ["g", "salt"]).select("g", "i", "salt", *[F.abs(F.col(x) - F.col(f"m_{x}")).alias(d) for x, d in zip(xs, ds)])
    means = away.groupBy("g").agg(*[F.avg(d).alias(f"mean_{d}") for d in ds])
    off, _ = cut(_brackets(away, ds, most).join(means, "g"), "off")
    mad = exact_medians(away, ds, off.drop(*[f"mean_{d}" for d in ds]))
    wide = med.join(off.select("g", *[f"mean_{d}" for d in ds]), "g", "left").join(mad, "g", "left")
    for x, d in zip(xs, ds):
        m, mean = F.col(f"m_{d}"), F.col(f"mean_{d}")
        wide = wide.withColumn(f"s_{x}", F.when(m > 0, m * MAD_TO_SD).when(mean > 0, mean * MEAN_TO_SD))
    met = salted.join(_spread(wide.select("g", "salts", *[f"{a}_{x}" for x in xs for a in "ms"])), ["g", "salt"], "left")

    fused, plain = F.lit(0.0), F.lit(0.0)
    for x, c in zip(xs, scores):
        v, s = F.col(x), F.col(f"s_{x}")
        z = F.when(s > 0, (v - F.col(f"m_{x}")) / s).otherwise(0.0)
        z = F.least(F.lit(600.0), F.greatest(F.lit(-600.0), z))
        squashed = F.when(z > -30, -F.log1p(F.exp(-z))).otherwise(z)  # log of the logistic function
        fused = fused + scores[c] / total * F.when(v.isNull(), -700.0).otherwise(squashed)
        plain = plain + scores[c] / total * F.when(v.isNull(), -700.0).otherwise(z)
    scored = met.select("g", "i", fused.alias("fused"), plain.alias("plain")).select("g", "i", F.struct(F.round("fused", PLACES).alias("key"), F.round("plain", PLACES).alias("second"), "fused").alias("f"))
    scored = scored.groupBy("g", "i").agg(F.max("f").alias("f")).select("g", "i", "f.key", "f.second", "f.fused")
    if keep:
        w = Window.partitionBy("g").orderBy(F.desc("key"), F.desc("second"), "i")
        ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    else:
        ranked = _rank(scored)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "fused", F.col("rank").cast("long").alias("rank"))


def candidate_ranking(neighbor_scores: DataFrame, weights: dict[str, float] | None = None, keep: int | None = None) -> DataFrame:
    """Each title's candidates ranked by the three similarity components, by default of equal weight."""
    return fuse_scores(neighbor_scores, "title", "neighbor", weights or {"tf_idf": 1.0, "named_locations": 1.0, "categories": 1.0}, keep)
