"""Points near other points, and points in regions, by coverings of grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlaswright.functions.geo import EARTH_KM, haversine_km, usable_position
from atlaswright.session import cut


def current_positions(coordinates: DataFrame) -> DataFrame:
    """``title, lat, lon`` of each title's usable row with the latest ``revised_at``.

    Rows with a null or unusable position or a null title do not count; a null ``revised_at`` is
    older than any other; equal times are settled by the larger position.
    """
    ok = coordinates.where(F.col("title").isNotNull() & usable_position(F.col("lat"), F.col("lon")))
    best = ok.groupBy("title").agg(F.max(F.struct("revised_at", "lat", "lon")).alias("p"))
    return best.select("title", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


DENSE = 256  # points of a cell beyond which it is divided
PARTS = 4  # rows and columns that a cell is divided into; a power of two, so that small cells nest exactly
LEVELS = 6  # of ever smaller cells


def _row(lat: Column, side: float, level: int) -> Column:
    return F.floor((lat + 90.0) / side * float(PARTS**level)).cast("long")


def _columns(row: Column, side: float, level: int) -> Column:
    """Number of cells around the globe in a row of this level: none is narrower than its height anywhere in its band."""
    south = F.floor(row / PARTS**level) * side - 90.0
    most = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + side)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(most)) / side)).cast("long") * PARTS**level


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * columns).cast("long"), columns)


def _half_width(lat: Column, at: Column, km: float) -> Column:
    """Degrees of longitude that the disc around a point of latitude ``lat`` reaches to either side at latitude ``at``: 0 beyond it, 180 around a pole."""
    c = (math.cos(km / EARTH_KM) - F.sin(F.radians(lat)) * F.sin(F.radians(at))) / (F.cos(F.radians(lat)) * F.cos(F.radians(at)))
    return F.when(F.isnan(c) | (c <= -1), 180.0).when(c >= 1, 0.0).otherwise(F.degrees(F.acos(c)))


def _covered(discs: DataFrame, side: float, level: int, km: float) -> DataFrame:
    """The cells of one level that the northern half of each disc reaches, within the parent cell if there is one; ``inside`` if wholly in it.

    A row's reach is worked out once from the disc's width at the row's edges, so cells outside the disc never come up.
    """
    height = side / PARTS**level
    reach = math.degrees(km / EARTH_KM)
    top = F.least(F.lit(90.0), F.col("lat") + reach * (1 + 1e-9))
    lo, hi = _row(F.col("lat"), side, level), _row(top, side, level)
    if level:
        lo, hi = F.greatest(lo, F.col("row") * PARTS), F.least(hi, F.col("row") * PARTS + PARTS - 1)
        discs = discs.withColumn("__c0", F.col("col") * PARTS).withColumn("__c1", F.col("col") * PARTS + PARTS - 1)
    rows = discs.where(lo <= hi).withColumn("row", F.explode(F.sequence(lo, hi))).withColumn("columns", _columns(F.col("row"), side, level))
    south, north = F.greatest("lat", F.col("row") * height - 90.0), F.least(top, (F.col("row") + 1) * height - 90.0)
    # the disc is widest a little north of its centre
    ratio = F.sin(F.radians("lat")) / math.cos(km / EARTH_KM)
    widest = F.when(ratio >= 1, 90.0).when(ratio <= -1, F.col("lat")).otherwise(F.degrees(F.asin(ratio)))
    rows = rows.withColumn("__out", _half_width(F.col("lat"), F.least(F.greatest(widest, south), north), km) * (1 + 1e-9) + 1e-9)
    within = F.least(_half_width(F.col("lat"), south, km), _half_width(F.col("lat"), north, km)) * (1 - 1e-9) - 1e-9
    rows = rows.withColumn("__in", F.when((F.col("lat") + reach <= 90) & ((F.col("row") + 1) * height - 90.0 <= F.col("lat") + reach * (1 - 1e-9)), within).otherwise(-1.0))
    width, x = 360.0 / F.col("columns"), F.col("lon") + 180.0
    west, east = F.floor((x - F.col("__out")) / width).cast("long"), F.floor((x + F.col("__out")) / width).cast("long")
    east = F.least(east, west + F.col("columns") - 1)
    wide = (F.col("__out") >= 120.0) | (F.col("columns") <= 8 * PARTS**level)
    if level:
        # the parent's columns as seen from the disc, which may lie across the date line; near a pole it may meet both their ends
        turn = F.floor(((F.col("__c0") + PARTS / 2) * width - x + 180.0) / 360.0).cast("long") * F.col("columns")
        west, east = F.when(wide, west).otherwise(F.greatest(west, F.col("__c0") - turn)), F.when(wide, east).otherwise(F.least(east, F.col("__c1") - turn))
    cells = rows.withColumn("__c", F.explode(F.when(west <= east, F.sequence(west, east)).otherwise(F.array().cast("array<bigint>"))))
    if level:
        cells = cells.where(~wide | F.pmod("__c", "columns").between(F.col("__c0"), F.col("__c1")))
    inside = (F.col("__c") * width >= x - F.col("__in")) & ((F.col("__c") + 1) * width <= x + F.col("__in")) & (F.col("__in") > 0)
    return cells.select("id", "lat", "lon", F.lit(level).alias("level"), "row", F.pmod("__c", "columns").alias("col"), inside.alias("inside"))


def points_within(points: DataFrame, id_col: str, lat: str, lon: str, km: float, dense: int = DENSE, levels: int = LEVELS, block: int = 2000) -> DataFrame:
    """All pairs ``id_a < id_b`` of points at most ``km`` apart on the sphere, poles and date line included.

    The northern half of the disc around each point is covered with grid cells (of two points the southern one, or at equal latitude the one of the
    smaller id, finds the other). The covering adapts to the density: a cell of about ``km`` side holding more than ``dense`` points is divided into
    4 x 4 smaller ones, these again, up to ``levels`` times. Cells that lie wholly in the disc accept their points by the
    equi-join alone, at whatever level; points of boundary cells get the exact distance test; cells outside are
    never made. Cells with more than ``block`` points are split into salted blocks, so a place
    that holds a third of all points spreads over many tasks.

    Rows with a null id, a null, NaN or out-of-range position do not count. Repeated rows of one id and
    position count once; points at the same place are pairs (distance 0).
    """
    side = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p, _ = cut(p.where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).distinct(), "points")
    p = p.withColumn("row", _row(F.col("lat"), side, 0))

    # divided and crowded cells, level by level: only points of divided cells go on to the next one
    key, on = ["row", "col"], ["level", "row", "col"]
    owned = [p.withColumn("col", _column(F.col("lon"), _columns(F.col("row"), side, 0)))]
    crowds: list[DataFrame] = []
    for level in range(levels + 1):
        many, _ = cut(owned[level].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(dense, block)), "crowds")
        crowds.append(many.select(F.lit(level).alias("level"), *key, (F.col("n") > dense if level < levels else F.lit(False)).alias("divided"), F.ceil(F.col("n") / block).alias("salts")))
        if level == levels or many.where(F.col("n") > dense).isEmpty():
            break
        finer = owned[level].join(crowds[level].where("divided").select(*key), key, "left_semi").withColumn("row", _row(F.col("lat"), side, level + 1))
        owned.append(finer.withColumn("col", _column(F.col("lon"), _columns(F.col("row"), side, level + 1))))

    left, right = [], []
    discs = p.select("id", "lat", "lon")
    for level, (own, many) in enumerate(zip(owned, crowds)):
        cells = _covered(discs, side, level, km).join(many, on, "left")
        right.append(own.select("id", "lat", "lon", F.lit(level).alias("level"), *key).join(many.select(*on, "salts"), on, "left"))
        stop = F.col("inside") | F.coalesce(~F.col("divided"), F.lit(True))
        if level + 1 < len(crowds):
            cells, _ = cut(cells, "cells")
            discs = cells.where(~stop).select("id", "lat", "lon", *key)
        left.append(cells.where(stop).drop("divided"))
    right_all, left_all = right[0], left[0]
    for r, c in zip(right[1:], left[1:]):
        right_all, left_all = right_all.unionByName(r), left_all.unionByName(c)
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    right_all = right_all.select(*on, F.pmod(F.xxhash64("id"), salts).alias("salt"), F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    left_all = left_all.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("id").alias("id_a"), "lat", "lon", "inside")

    # the covering is larger than its table's size suggests, so it must not be taken for a side to broadcast
    pairs = left_all.join(right_all.hint("merge"), [*on, "salt"]).where((F.col("lat_b") > F.col("lat")) | ((F.col("lat_b") == F.col("lat")) & (F.col("id_a") < F.col("id_b"))))
    close = F.when(F.col("inside"), True).otherwise(haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= km)
    found = pairs.where(close).where("id_a <> id_b")
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def near_titles(coordinates: DataFrame, km: float = 1.0) -> DataFrame:
    """``title_a < title_b`` for titles whose current positions lie within ``km``."""
    return points_within(current_positions(coordinates), "title", "lat", "lon", km).select(F.col("id_a").alias("title_a"), F.col("id_b").alias("title_b"))


def _polygon_cells(lats: list[float], lons: list[float], top: float, finest: float) -> Iterator[tuple[int, int, int, bool]]:
    """Cells (level, row, column, interior) covering a polygon: squares are halved while the outline crosses them."""
    edges = [((lats[k - 1], lons[k - 1]), (lats[k], lons[k])) for k in range(len(lats))]

    def crosses(s: float, w: float, n: float, e: float, own: list) -> list:
        hit = []
        for (y0, x0), (y1, x1) in own:
            t0, t1 = 0.0, 1.0
            for p, q in ((-(x1 - x0), x0 - w), (x1 - x0, e - x0), (-(y1 - y0), y0 - s), (y1 - y0, n - y0)):
                if p == 0:
                    if q < 0:
                        t0, t1 = 1.0, 0.0
                elif p < 0:
                    t0 = max(t0, q / p)
                else:
                    t1 = min(t1, q / p)
            if t0 <= t1:
                hit.append(((y0, x0), (y1, x1)))
        return hit

    def inside(y: float, x: float) -> bool:
        odd = False
        for (y0, x0), (y1, x1) in edges:
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
        return odd

    todo = [
        (0, r, c, edges)
        for r in range(math.floor((min(lats) + 90) / top), math.floor((max(lats) + 90) / top) + 1)
        for c in range(math.floor((min(lons) + 180) / top), math.floor((max(lons) + 180) / top) + 1)
    ]
    while todo:
        level, r, c, own = todo.pop()
        side = top / 2**level
        s, w = r * side - 90, c * side - 180
        hit = crosses(s - 1e-9, w - 1e-9, s + side + 1e-9, w + side + 1e-9, own)
        if not hit:
            if inside(s + side / 2, w + side / 2):
                yield level, r, c, True
        elif side <= finest:
            yield level, r, c, False
        else:
            todo += [(level + 1, 2 * r + a, 2 * c + b, hit) for a in (0, 1) for b in (0, 1)]


def points_in_regions(points: DataFrame, regions: DataFrame, cell_deg: float = 8.0, levels: int = 6, block: int = 5000) -> DataFrame:
    """``id, region``: each point with every region that contains it.

    ``points``: id, lat, lon. ``regions``: region, ring array<struct<lat, lon>>, a simple polygon in the
    plane of longitude and latitude (cut it at the date line before). Regions are covered with cells halved up
    to ``levels`` times along their outline; points join on the cell of each level. Interior cells
    accept at once; only points of boundary cells are tested against the ring. Cells with many points are salted.

    Null ids, positions or rings, and rings of fewer than three corners, give no row. A point on an outline counts as
    inside on the south and west sides (half-open rule); overlapping regions each give a row.
    """
    finest = cell_deg / 2**levels
    rings = regions.where("region is not null and size(ring) >= 3").select("region", "ring").distinct()

    def cover(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for region, ring in zip(pdf["region"], pdf["ring"]):
                pts = [(q["lat"], q["lon"]) for q in ring if q is not None and q["lat"] is not None and q["lon"] is not None]
                if len(pts) >= 3:
                    out += [(region, *cell) for cell in _polygon_cells([a for a, _ in pts], [b for _, b in pts], cell_deg, finest)]
            yield pd.DataFrame(out, columns=["region", "level", "row", "col", "interior"])

    kind = rings.schema["region"].dataType.simpleString()
    cells = rings.mapInPandas(cover, f"region {kind}, level int, row long, col long, interior boolean")
    p = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    p = p.where("id is not null and lat between -90 and 90 and lon between -180 and 180").distinct()
    at = p.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    side = F.lit(cell_deg) / F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumn("row", F.floor((F.col("lat") + 90) / side)).withColumn("col", F.floor((F.col("lon") + 180) / side))
    used = cells.select("level", "row", "col").distinct()
    at = at.join(used, ["level", "row", "col"], "left_semi")
    hot = at.groupBy("level", "row", "col").count().where(F.col("count") > block).select("level", "row", "col", F.ceil(F.col("count") / block).alias("salts"))
    at = at.join(hot, ["level", "row", "col"], "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(0)).drop("salts")
    cells = cells.join(hot, ["level", "row", "col"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    met = at.join(cells, ["level", "row", "col", "salt"])
    sure = met.where("interior").select("id", "region")
    doubt = met.where("not interior").join(rings, "region")
    following = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    y, x = F.col("lat"), F.col("lon")

    def cross(a: Column, b: Column) -> Column:
        spans = (a["lat"] > y) != (b["lat"] > y)
        return F.when(spans & (x < (b["lon"] - a["lon"]) * (y - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0)

    odd = F.aggregate(F.zip_with("ring", following, cross), F.lit(0), lambda acc, q: acc + q) % 2 == 1
    return sure.unionByName(doubt.where(odd).select("id", "region"))
