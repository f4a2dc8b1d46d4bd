"""Irregular readings onto a regular grid by shape-preserving cubic interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_index(ts: Column) -> Column:
    """Months since year 0 of a timestamp (session time zone)."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_label(index: Column) -> Column:
    """``yyyy-mm`` of a month index."""
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Three-point slope at the end of a segment, limited so that the curve keeps the data's shape."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(d1.isNull(), d0).when(s * d0 <= 0, 0.0).when((d0 * d1 < 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def regular_grid(
    readings: DataFrame,
    keys: list[str],
    period: Column,
    value: Column,
    max_gap: int = 3,
    shard_len: int | None = None,
) -> DataFrame:
    """One row for each key and period between the key's first and last reading.

    ``period`` is an integer index of the grid (month, hour, ...). Several readings of one
    period give their mean. Runs of at most ``max_gap`` missing periods are filled by monotone
    cubic interpolation (harmonic-mean slopes, so no overshoot); longer runs stay null.
    Output: keys, ``period``, ``value``, ``n_readings``, ``status`` (``observed``, ``filled`` or ``gap``).

    The series of a key is cut into shards of ``shard_len`` periods, worked on independently:
    the readings of ``2 * (max_gap + 1)`` periods on either side come along as a halo, enough
    for both neighbours and their slopes, as a segment never reaches over a longer gap. So even
    one key with most of the rows spreads over many tasks, after a partial aggregation to periods.

    Null or NaN values, null keys and null periods do not count; a key without any usable
    reading gives no row; repeated rows weigh in the mean (deduplicate before, if they should not).
    """
    halo = 2 * (max_gap + 1)
    size = max(shard_len or 8 * halo, halo)
    t, v = "__t", "__v"
    rows = readings.select(*keys, period.cast("long").alias(t), value.cast("double").alias(v))
    rows = rows.where(F.col(t).isNotNull() & F.col(v).isNotNull() & ~F.isnan(v))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    knots = rows.groupBy(*keys, t).agg(F.avg(v).alias(v), F.count(F.lit(1)).alias("__n"))

    s = F.floor(F.col(t) / size).cast("long")
    near = F.array(
        s,
        F.when(F.col(t) - s * size < halo, s - 1),
        F.when((s + 1) * size - F.col(t) <= halo, s + 1),
    )
    spread = knots.select(*keys, F.explode(F.array_compact(near)).alias("__s"), t, v, "__n")
    ends = knots.groupBy(*keys).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    shards = ends.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor(F.col("__hi") / size))).alias("__s"))
    grid = shards.select(
        *keys, F.col("__s").cast("long").alias("__s"),
        F.explode(F.sequence(F.greatest("__lo", F.col("__s") * size), F.least("__hi", (F.col("__s") + 1) * size - 1))).alias(t),
        F.lit(None).cast("double").alias(v), F.lit(0).cast("long").alias("__n"),
    )
    w = Window.partitionBy(*keys, "__s").orderBy(t, F.col(v).isNull())
    merged = spread.unionByName(grid).withColumn("__same", F.lag(t).over(w)).where(F.col(v).isNotNull() | F.coalesce(F.col("__same") != F.col(t), F.lit(True)))

    w = Window.partitionBy(*keys, "__s").orderBy(t)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("x"), F.col(v).alias("y")))
    m = merged.withColumn("__k", known).withColumn("__p", F.last("__k", True).over(back)).withColumn("__q", F.first("__k", True).over(ahead))
    # neighbours over a longer gap belong to another segment
    m = m.withColumn("__p", F.when(F.col(t) - F.col("__p.x") <= max_gap + 1, F.col("__p")))
    m = m.withColumn("__q", F.when(F.col("__q.x") - F.col(t) <= max_gap + 1, F.col("__q")))
    h0, h1 = (F.col(t) - F.col("__p.x")).cast("double"), (F.col("__q.x") - F.col(t)).cast("double")
    d0, d1 = (F.col(v) - F.col("__p.y")) / h0, (F.col("__q.y") - F.col(v)) / h1
    m = m.withColumns({"__h0": h0, "__h1": h1, "__d0": d0, "__d1": d1})
    # the next intervals out, for slopes at the ends of a segment
    real = F.col(v).isNotNull()
    far = F.when(real, F.struct(F.col("__h0").alias("h0"), F.col("__d0").alias("d0"), F.col("__h1").alias("h1"), F.col("__d1").alias("d1")))
    m = m.withColumn("__e", far).withColumn("__pe", F.last("__e", True).over(back)).withColumn("__qe", F.first("__e", True).over(ahead))
    a0, a1, b0, b1 = F.col("__h0"), F.col("__h1"), F.col("__d0"), F.col("__d1")
    inner = F.when(b0 * b1 <= 0, 0.0).otherwise((3 * (a0 + a1)) / ((2 * a1 + a0) / F.when(b0 != 0, b0) + (a1 + 2 * a0) / F.when(b1 != 0, b1)))
    slope = (
        F.when(b0.isNotNull() & b1.isNotNull(), inner)
        .when(b1.isNotNull(), _end_slope(a1, F.col("__qe.h1"), b1, F.col("__qe.d1")))
        .when(b0.isNotNull(), _end_slope(a0, F.col("__pe.h0"), b0, F.col("__pe.d0")))
        .otherwise(0.0)
    )
    m = m.withColumn("__m", F.when(real, F.struct(F.col(t).alias("x"), F.col(v).alias("y"), slope.alias("m"))))
    m = m.withColumn("__l", F.last("__m", True).over(back)).withColumn("__r", F.first("__m", True).over(ahead))
    h = (F.col("__r.x") - F.col("__l.x")).cast("double")
    u = (F.col(t) - F.col("__l.x")) / h
    cubic = (
        (1 + 2 * u) * (1 - u) * (1 - u) * F.col("__l.y") + u * (1 - u) * (1 - u) * h * F.col("__l.m")
        + u * u * (3 - 2 * u) * F.col("__r.y") + u * u * (u - 1) * h * F.col("__r.m")
    )
    filled = F.when(h <= max_gap + 1, cubic)
    own = F.floor(F.col(t) / size) == F.col("__s")
    return m.where(own).select(
        *keys, F.col(t).alias("period"), F.coalesce(F.col(v), filled).alias("value"), F.col("__n").alias("n_readings"),
        F.when(real, "observed").when(filled.isNotNull(), "filled").otherwise("gap").alias("status"),
    )


def view_readings(article_views: DataFrame, start: str = "2019-01-01", end: str = "2020-01-01") -> DataFrame:
    """Usable readings (title, stamp, views) of view-service replies.

    Usable: ``stamp`` in [start, end), ``views`` a number of at least 0. A reading that came
    in several replies counts once, as the latest reply gives it. Null or empty ``items``,
    null titles and null stamps give nothing.
    """
    flat = article_views.where("title is not null").select("title", "fetched_at", F.explode("items").alias("i"))
    flat = flat.select("title", "fetched_at", F.col("i.stamp").alias("stamp"), F.col("i.views").alias("views"))
    ok = (F.col("stamp") >= F.lit(start).cast("timestamp")) & (F.col("stamp") < F.lit(end).cast("timestamp")) & (F.col("views") >= 0) & ~F.isnan("views")
    return flat.where(ok).groupBy("title", "stamp").agg(F.max(F.struct("fetched_at", "views"))["views"].alias("views"))


def monthly_views(article_views: DataFrame, max_gap: int = 3) -> DataFrame:
    """The monthly series of each title: ``title, year_month, views, n_readings, status``."""
    grid = regular_grid(view_readings(article_views), ["title"], month_index(F.col("stamp")), F.col("views"), max_gap)
    return grid.select("title", month_label(F.col("period")).alias("year_month"), F.col("value").alias("views"), "n_readings", "status")
