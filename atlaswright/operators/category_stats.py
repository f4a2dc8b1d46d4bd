"""Geographic statistics of categories, with leave-one-out values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlaswright.functions.geo import haversine_km
from atlaswright.operators import category_view
from atlaswright.operators.skew import salted_join
from atlaswright.session import cut


def _units(c: str) -> Column:
    """Degrees as a whole number of units of 1e-12: their sums are the same in any order of the rows."""
    return F.round(F.col(c) * 1e12).cast("decimal(20,0)")


def _mean(total: Column, n: Column) -> Column:
    """Mean degrees of a sum of units, rounded (half up) to nine places in whole numbers, so that it is the same in any order of the rows and on any engine."""
    n = n.cast("decimal(20,0)")
    shifted = total + n * F.lit(10**15)  # by a thousand degrees, so that nothing is negative
    return (F.call_function("div", shifted * 2 + n * 1000, n * 2000) - 10**12) / 1e9


def _members(categories: DataFrame, positions: DataFrame) -> DataFrame:
    rows = categories.where("title is not null and category is not null").select("title", "category")
    return rows.join(positions.select("title", "lat", "lon"), "title", "left")


def category_stats(categories: DataFrame, positions: DataFrame) -> DataFrame:
    """``category, n_articles, n_located, lat, lon, dispersion``.

    Articles count once for each time they name the category; the mean position and the mean distance to it are over
    located articles, each once. Both are null for a category without located articles. Means are arithmetic, in degrees, to nine places.
    """
    m = _members(categories, positions)
    counts = m.groupBy("category").agg(F.count(F.lit(1)).alias("n_articles"))
    each = m.where("lat is not null and lon is not null").distinct()
    mean = each.groupBy("category").agg(F.count(F.lit(1)).alias("n_located"), _mean(F.sum(_units("lat")), F.count("lat")).alias("mean_lat"), _mean(F.sum(_units("lon")), F.count("lon")).alias("mean_lon"))
    away = each.join(mean, "category").groupBy("category").agg(F.avg(haversine_km(F.col("lat"), F.col("lon"), F.col("mean_lat"), F.col("mean_lon"))).alias("dispersion"))
    out = counts.join(mean, "category", "left").join(away, "category", "left")
    return out.select("category", "n_articles", F.coalesce("n_located", F.lit(0)).cast("long").alias("n_located"), F.col("mean_lat").alias("lat"), F.col("mean_lon").alias("lon"), "dispersion")


def leave_one_out_means(categories: DataFrame, positions: DataFrame) -> DataFrame:
    """``category, title, lat, lon, others``: the mean position of a category without one of its located articles.

    Null where no other article is located. Sums are aggregated first and joined back, so a category of most
    articles is never gathered.
    """
    return _means_without(_located(categories, positions)).drop("y", "x")


def _located(categories: DataFrame, positions: DataFrame) -> DataFrame:
    return _members(categories, positions).where("lat is not null and lon is not null").distinct()


def _means_without(each: DataFrame) -> DataFrame:
    """The means without each row of ``each``; ``y`` and ``x`` are its own position."""
    sums = each.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(_units("lat")).alias("sum_lat"), F.sum(_units("lon")).alias("sum_lon"))
    others = F.col("n") - 1
    safe = F.when(others > 0, others)
    less = lambda c: _mean(F.col(f"sum_{c}") - _units(c), safe)
    return each.join(sums, "category").select("category", "title", less("lat").alias("lat"), less("lon").alias("lon"), others.alias("others"), F.col("lat").alias("y"), F.col("lon").alias("x"))


#: Nodes in each direction, and how far a position is from the box of the means, in half its longest side, to count by interpolation: what that leaves out is some 64 ** -8 of the box.
_NODES, _FAR = 8, 32


def leave_one_out_dispersions(categories: DataFrame, positions: DataFrame, requests: DataFrame | None = None, direct: int = 512) -> DataFrame:
    """``category, title, dispersion``: mean distance of the other located articles to their mean; with ``requests`` (category, title) only for these.

    Distances do not decompose. In categories of up to ``direct`` requested articles every one of them meets every other located one; pairs go straight into
    partial averages. In larger ones the means without one article lie close together, in a box that shrinks with the number of articles, and the sum of all distances to a point of it
    is as smooth as can be but for the positions near the box or opposite to it. So sums of distances are worked out at Chebyshev nodes of the box and interpolated, which is
    right to the last digits of a double, and those few positions are met one by one, equal ones once. The work is in proportion to the articles.
    """
    each, _ = cut(_located(categories, positions).select("category", "title", "lat", "lon"), "located")
    means = _means_without(each).where("others > 0")
    if requests is not None:
        means = means.join(requests.select("category", "title"), ["category", "title"], "left_semi")
    means, _ = cut(means, "means")
    box = means.groupBy("category").agg(F.count(F.lit(1)).alias("c"), *[f(x).alias(f"{x}_{f.__name__}") for x in ("lat", "lon") for f in (F.min, F.max)]).where(F.col("c") > direct)
    box, _ = cut(box.select("category", *_box("lat"), *_box("lon")), "boxes")
    if box.isEmpty():
        return _met(means, each)
    return _met(means.join(box, "category", "left_anti"), each).unionByName(_interpolated(means, each, box))


def _box(x: str) -> list[Column]:
    """Middle and half side (never 0) of the box of the means."""
    lo, hi = F.col(f"{x}_min"), F.col(f"{x}_max")
    return [((lo + hi) / 2).alias(f"{x}_mid"), F.greatest((hi - lo) / 2 * 1.0001, F.lit(1e-6)).alias(f"{x}_half")]


def _met(means: DataFrame, each: DataFrame) -> DataFrame:
    """Every mean meets every other article of its category, salted for large categories."""
    others = each.select("category", F.col("title").alias("other"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    met = salted_join(means.drop("y", "x"), others, ["category"], "title", 2000).where("title <> other")
    return met.groupBy("category", "title").agg(F.avg(haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))).alias("dispersion"))


def _interpolated(means: DataFrame, each: DataFrame, box: DataFrame) -> DataFrame:
    k = _NODES
    at = [math.cos((2 * j + 1) * math.pi / (2 * k)) for j in range(k)]
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_mid"), F.col("lon_mid"))
    reach = haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.least(F.lit(180.0), _FAR * F.greatest("lat_half", "lon_half")))
    half_way = math.pi * 6371.0
    placed = each.join(box, "category").withColumn("near", (km <= reach) | (km >= half_way - reach))

    nodes = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1)))
    node = lambda x, j: F.col(f"{x}_mid") + F.col(f"{x}_half") * F.element_at(F.array(*map(F.lit, at)), (j + 1).cast("int"))
    spread = placed.where("not near").select("category", "lat", "lon", "lat_mid", "lon_mid", "lat_half", "lon_half", nodes.alias("node"))
    to = haversine_km(F.col("lat"), F.col("lon"), node("lat", F.floor(F.col("node") / k)), node("lon", F.col("node") % k))
    sums = spread.groupBy("category", "node").agg(F.sum(to).alias("s")).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("node", "s"))).alias("sums"))
    sums, _ = cut(sums, "sums")

    # Lagrange's polynomials of the nodes, by the distances of a mean to all nodes
    def weights(x: str) -> Column:
        u = (F.col(x) - F.col(f"{x}_mid")) / F.col(f"{x}_half")
        one = lambda j: math.prod(at[j] - at[i] for i in range(k) if i != j)
        terms = []
        for j in range(k):
            p = F.lit(1 / one(j))
            for i in range(k):
                if i != j:
                    p = p * (u - at[i])
            terms.append(p)
        return F.array(*terms)

    pick = lambda w, j: F.element_at(F.col(w), (j + 1).cast("int"))
    m = means.join(box, "category").join(sums, "category", "left").withColumn("wy", weights("lat")).withColumn("wx", weights("lon"))
    whole = F.aggregate(F.coalesce("sums", F.array().cast("array<struct<node:int,s:double>>")), F.lit(0.0), lambda t, e: t + e["s"] * pick("wy", F.floor(e["node"] / k)) * pick("wx", e["node"] % k))
    # the article itself is among the interpolated positions, unless it is near
    away = haversine_km(F.col("y"), F.col("x"), F.col("lat_mid"), F.col("lon_mid"))
    itself = haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))
    far = m.select("category", "title", "others", (whole - F.when((away <= reach) | (away >= half_way - reach), 0.0).otherwise(itself)).alias("s"), "lat", "lon", "y", "x")

    close = placed.where("near").groupBy("category", F.col("lat").alias("near_y"), F.col("lon").alias("near_x")).agg(F.count(F.lit(1)).alias("times"))
    mine = F.when((F.col("near_y") == F.col("y")) & (F.col("near_x") == F.col("x")), 1).otherwise(0)
    met = salted_join(far, close, ["category"], "title", 2000).where(F.col("times") > mine)
    extra = met.groupBy("category", "title").agg(F.sum(haversine_km(F.col("near_y"), F.col("near_x"), F.col("lat"), F.col("lon")) * (F.col("times") - mine)).alias("extra"))
    return far.join(extra, ["category", "title"], "left").select("category", "title", ((F.col("s") + F.coalesce("extra", F.lit(0.0))) / F.col("others")).alias("dispersion"))


def requester_view(requests: DataFrame, categories: DataFrame, positions: DataFrame, compat: bool = False, crowded: int = category_view.MOST) -> DataFrame:
    """What a category looks like to a title: ``category, title, lat, lon, dispersion, n_located, ratio``.

    ``requests``: category, title. ``positions`` has a title once at most. A title that is a located member sees its category without itself; others see all of it. ``ratio`` is
    located / (articles + 1), 0 if no article is left. With ``compat`` the only located member still counts itself.

    Rows are shuffled to their category once. A category of more than ``crowded`` rows goes to several groups, which get its totals and the sums of distances at its nodes
    (:func:`leave_one_out_dispersions`) along with them; any other is worked out from its own rows.
    """
    named = categories.where("category is not null")
    times = F.when(F.col("title").isNotNull(), 1).otherwise(0)
    if requests is categories:
        named = named.groupBy("title", "category").agg(F.sum(times).alias("times")).withColumn("asked", F.lit(1))
    else:
        asked = requests.where("category is not null").select("title", "category", F.lit(0).alias("times"), F.lit(1).alias("asked"))
        both = named.select("title", "category", times.alias("times"), F.lit(0).alias("asked")).unionByName(asked)
        named = both.groupBy("title", "category").agg(F.sum("times").alias("times"), F.max("asked").alias("asked"))
    rows, _ = cut(named.join(positions.select("title", "lat", "lon"), "title", "left").select("category", "title", "lat", "lon", "times", "asked"), "rows")

    data = rows.select("*", F.lit(0).alias("kind"), F.array().cast("array<double>").alias("sums"))  # nulls in an array column are slow to send to Python
    hot = _crowded(rows, crowded)
    if hot is None:
        grouped = data.withColumn("key", F.xxhash64("category", F.lit(0).cast("long")))
    else:
        salted = data.join(hot.select("category", "salts"), "category", "left")
        salted = salted.withColumn("key", F.xxhash64("category", F.coalesce(F.pmod(F.xxhash64("title"), F.col("salts")), F.lit(0)).cast("long"))).drop("salts")
        grouped = salted.unionByName(_totals(rows, hot))
    view = category_view.views(compat)
    return grouped.repartition("key").sortWithinPartitions("key").mapInArrow(view, category_view.VIEW)


def _crowded(rows: DataFrame, most: int) -> DataFrame | None:
    """``category, salts``: categories of more than ``most`` rows. Hashes are counted first, and only categories in crowded hashes by name."""
    part = F.pmod(F.xxhash64("category"), F.lit(1 << 16)).alias("part")
    parts, _ = cut(rows.groupBy(part).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("part"), "parts")
    if parts.isEmpty():
        return None
    counts = rows.select("category", part).join(parts, "part", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most)
    hot, _ = cut(counts.select("category", F.ceil(F.col("c") / most).cast("long").alias("salts")), "crowded")
    return None if hot.isEmpty() else hot


def _totals(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The totals of crowded categories, and positions near the box of their means, for each of their salts; as rows of ``requester_view``."""
    there = "times > 0 and lat is not null and lon is not null"
    own = rows.join(hot, "category").withColumn("located", F.expr(there))

    def units(c: str) -> Column:
        x = F.when(F.col("located"), F.col(c) * 1e12)
        whole = x.cast("long")
        return whole + F.when(F.abs(x - whole) >= 0.5, F.signum(x).cast("long")).otherwise(0)

    million = F.lit(10**6).cast("long")
    sums = [F.coalesce(F.sum(e), F.lit(0).cast("long")).alias(f"{c}_{n}") for c in ("lat", "lon") for n, e in (("high", F.call_function("div", units(c), million)), ("low", units(c) % million))]
    ends = [f(F.when(F.col("located"), F.col(c))).alias(f"{c}_{f.__name__}") for c in ("lat", "lon") for f in (F.min, F.max)]
    t = own.groupBy("category").agg(F.first("salts").alias("salts"), F.sum("times").alias("n_articles"), F.count(F.when(F.col("located"), 1)).alias("n"), *sums, *ends)
    whole = lambda c: F.col(f"{c}_high").cast("decimal(20,0)") * million + F.col(f"{c}_low")
    n = F.when(F.col("n") > 0, F.col("n"))
    less = F.greatest(F.col("n") - 1, F.lit(1))
    middle = lambda c: whole(c).cast("double") / 1e12 / less - (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2 / less
    half = lambda c: F.greatest((F.col(f"{c}_max") - F.col(f"{c}_min")) / 2 / less * 1.0001, F.lit(1e-6))
    boxes = [middle("lat").alias("mid_y"), half("lat").alias("half_y"), middle("lon").alias("mid_x"), half("lon").alias("half_x")]
    means = [_mean(whole(c), n).alias(f"mean_{x}") for c, x in (("lat", "y"), ("lon", "x"))]
    parts = [e for c in ("lat", "lon") for e in (F.call_function("div", F.col(f"{c}_high"), million), F.col(f"{c}_high") % million, F.col(f"{c}_low"))]  # each exact as a double
    totals = F.array(*[e.cast("double") for e in (F.col("n_articles"), F.col("n"), *parts)]).alias("totals")
    t, _ = cut(t.select("category", "salts", "n", totals, *boxes, *means), "boxes")

    spread = rows.where(there).select("category", "lat", "lon").join(t.drop("salts", "totals"), "category")
    got, _ = cut(spread.mapInArrow(category_view.node_sums, category_view.SUMS), "sums")
    added = got.groupBy("category").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(category_view.NODES**2 + 1)]).alias("sums"))
    none = F.array_repeat(F.lit(0.0), category_view.NODES**2 + 1)
    one = t.join(added, "category", "left")
    one = one.select("category", "salts", F.lit(1).alias("kind"), F.concat("totals", F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("mid_y", "half_y", "mid_x", "half_x")]), F.coalesce("sums", none)).alias("sums"))
    near = got.where(F.size("near") > 0).join(t.select("category", "salts"), "category")
    near = near.select("category", "salts", F.lit(2).alias("kind"), F.col("near").alias("sums"))
    each = one.unionByName(near).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    empty = {"title": "string", "lat": "double", "lon": "double", "times": "bigint", "asked": "int"}
    return each.select("category", *[F.lit(None).cast(k).alias(c) for c, k in empty.items()], "kind", "sums", F.xxhash64("category", "salt").alias("key"))


def within_diameter(groups: DataFrame, most_km: float) -> DataFrame:
    """``key, diameter``: groups (key, name, lat, lon) whose points all lie within ``most_km`` of each other.

    A group's points are compared pairwise, salted for large groups (the entities of a page are few).
    """
    p = groups.where("key is not null and lat is not null and lon is not null").select("key", "name", "lat", "lon").distinct()
    q = p.select("key", F.col("name").alias("name_b"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    far = salted_join(p, q, ["key"], "name", 2000).where("name <= name_b").groupBy("key").agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).alias("diameter"))
    return far.where(F.col("diameter") <= most_km)
