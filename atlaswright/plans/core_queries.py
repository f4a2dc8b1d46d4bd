"""Queries and SQL of the general data operators: regular grids, hierarchies, proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.operators.hierarchy import category_hierarchy, descendants
from atlaswright.operators.proximity import current_positions, near_titles, points_in_regions
from atlaswright.operators.regular_grid import monthly_views


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without a usable reading between a title's first and last one."""
    series = monthly_views(table(spark, sf_dir, "article_views"))
    return series.where("status <> 'observed'").select("title", "year_month")


def p4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full monthly series with its marks."""
    s = monthly_views(table(spark, sf_dir, "article_views"))
    return s.select("title", "year_month", F.round("views", 6).alias("views"), "n_readings", "status")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each category; loops marked."""
    return category_hierarchy(table(spark, sf_dir, "subcategories"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root to each category."""
    t = category_hierarchy(table(spark, sf_dir, "subcategories"), paths=True)
    return t.select("category", "tree_root", "tree_depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category with all its descendants."""
    return descendants(category_hierarchy(table(spark, sf_dir, "subcategories"), paths=True))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles at most 1 km apart."""
    return near_titles(table(spark, sf_dir, "coordinates"))


def p7_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone, if any, that contains each title's current position."""
    points = current_positions(table(spark, sf_dir, "coordinates")).select(F.col("title").alias("id"), "lat", "lon")
    rows = [(f"zone {y} {x}", [(y + float(f"{a}.0001"), x + float(f"{b}.0001")) for a, b in _ZONE]) for y in range(-75, 76, 30) for x in range(-165, 166, 30)]
    regions = spark.createDataFrame(rows, "region string, ring array<struct<lat double, lon double>>")
    return points_in_regions(points, regions).select(F.col("id").alias("title"), "region")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_series, p5_found, p5_paths, p5_descendants, p7_found, p7_regions)}


def _reading(c: str) -> str:
    cut = f"regexp_replace({c}, '[|#].*$', '', 's')"
    bare = f"regexp_replace(regexp_replace({cut}, '^\\s*(category\\s*:)?\\s*', '', 'i'), '\\s+$', '')"
    return f"nullif(regexp_replace({bare}, '[\\s+]', '_', 'g'), '')"


_VIEWS = """
usable AS (
  SELECT title, i.stamp AS stamp, max_by(i.views, (coalesce(fetched_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), i.views)) AS views
  FROM (SELECT title, fetched_at, unnest(items) AS i FROM article_views WHERE title IS NOT NULL)
  WHERE i.stamp >= TIMESTAMPTZ '2019-01-01 00:00:00+00' AND i.stamp < TIMESTAMPTZ '2020-01-01 00:00:00+00'
    AND i.views >= 0 AND NOT isnan(i.views)
  GROUP BY title, i.stamp),
seen AS (SELECT DISTINCT title, CAST(month(CAST(timezone('UTC', stamp) AS TIMESTAMP)) AS INT) AS m FROM usable),
ends AS (SELECT title, min(m) AS lo, max(m) AS hi FROM seen GROUP BY title),
grid AS (SELECT title, unnest(range(lo, hi + 1)) AS m FROM ends)
"""

_TREE = f"""
rows AS (SELECT {_reading("category")} AS parent, subcategories AS kids FROM subcategories),
raw AS (SELECT parent, {_reading("kid")} AS child FROM (SELECT parent, unnest(kids) AS kid FROM rows)),
nodes AS (SELECT DISTINCT node FROM (SELECT parent AS node FROM rows UNION ALL SELECT child FROM raw) WHERE node IS NOT NULL),
links AS (SELECT DISTINCT parent, child FROM raw WHERE parent IS NOT NULL AND child IS NOT NULL),
up AS (SELECT child AS node, parent AS anc FROM links UNION SELECT up.node, links.parent FROM up JOIN links ON links.child = up.anc),
looped AS (SELECT DISTINCT node FROM up WHERE node = anc),
bad AS (SELECT node FROM looped UNION SELECT up.node FROM up JOIN looped ON up.anc = looped.node),
tops AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM links)),
tree AS (
  SELECT n.node AS category,
    CASE WHEN n.node IN (SELECT node FROM bad) THEN '' ELSE coalesce(max(CASE WHEN up.anc IN (SELECT node FROM tops) THEN up.anc END), n.node) END AS tree_root,
    CASE WHEN n.node IN (SELECT node FROM bad) THEN -1 ELSE count(DISTINCT up.anc) END AS tree_depth
  FROM nodes n LEFT JOIN up ON up.node = n.node GROUP BY n.node)
"""

_POSITIONS = """
pos AS (
  SELECT title, max_by(lat, revised_at) AS lat, max_by(lon, revised_at) AS lon FROM coordinates
  WHERE title IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)
  GROUP BY title)
"""


_SERIES = """
knot AS (SELECT title, m, avg(views) AS y, count(*) AS n FROM (SELECT title, CAST(month(CAST(timezone('UTC', stamp) AS TIMESTAMP)) AS INT) AS m, views FROM usable) GROUP BY title, m),
side AS (SELECT *, CASE WHEN m - lag(m) OVER w <= 4 THEN CAST(m - lag(m) OVER w AS DOUBLE) END AS h0, CASE WHEN lead(m) OVER w - m <= 4 THEN CAST(lead(m) OVER w - m AS DOUBLE) END AS h1,
  y - lag(y) OVER w AS dy0, lead(y) OVER w - y AS dy1 FROM knot WINDOW w AS (PARTITION BY title ORDER BY m)),
chord AS (SELECT *, dy0 / h0 AS d0, dy1 / h1 AS d1 FROM side),
next AS (SELECT *, lag(h0) OVER w AS ph, lag(d0) OVER w AS pd, lead(h1) OVER w AS qh, lead(d1) OVER w AS qd FROM chord WINDOW w AS (PARTITION BY title ORDER BY m)),
tip AS (SELECT *, CASE WHEN d0 IS NULL THEN d1 ELSE d0 END AS e0, CASE WHEN d0 IS NULL THEN qd ELSE pd END AS e1,
  CASE WHEN d0 IS NULL THEN ((2 * h1 + qh) * d1 - h1 * qd) / (h1 + qh) ELSE ((2 * h0 + ph) * d0 - h0 * pd) / (h0 + ph) END AS s FROM next),
slope AS (SELECT title, m, y, CASE
    WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN CASE WHEN d0 * d1 <= 0 THEN 0 ELSE 3 * (h0 + h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END
    WHEN d0 IS NULL AND d1 IS NULL THEN 0 WHEN e1 IS NULL THEN e0 WHEN s * e0 <= 0 THEN 0 WHEN e0 * e1 < 0 AND abs(s) > 3 * abs(e0) THEN 3 * e0 ELSE s END AS k FROM tip),
span AS (SELECT title, m AS x0, y AS y0, k AS k0, lead(m) OVER w AS x1, lead(y) OVER w AS y1, lead(k) OVER w AS k1 FROM slope WINDOW w AS (PARTITION BY title ORDER BY m)),
gone AS (SELECT g.title, g.m, CASE WHEN x1 - x0 <= 4 THEN
    (1 + 2 * u) * (1 - u) * (1 - u) * y0 + u * (1 - u) * (1 - u) * (x1 - x0) * k0 + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * (x1 - x0) * k1 END AS v
  FROM (SELECT grid.title, grid.m, x0, y0, k0, x1, y1, k1, CAST(grid.m - x0 AS DOUBLE) / (x1 - x0) AS u FROM grid JOIN span ON span.title = grid.title AND grid.m > x0 AND grid.m < x1) g)
"""

# four-cornered zones with a notch, one for each thirty degrees; the plain rule of crossings
_ZONE = [(-13, -12), (-3, 14), (12, 11), (2, -1)]
_ZONES = f"""
zone AS (SELECT 'zone ' || y || ' ' || x AS region, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM (SELECT unnest(range(-75, 76, 30)) AS y), (SELECT unnest(range(-165, 166, 30)) AS x)),
edge AS (SELECT region, y + dy0 AS y0, x + dx0 AS x0, y + dy1 AS y1, x + dx1 AS x1 FROM zone, (VALUES {", ".join(f"({a[0]}.0001, {a[1]}.0001, {b[0]}.0001, {b[1]}.0001)" for a, b in zip(_ZONE, _ZONE[1:] + _ZONE[:1]))}) e(dy0, dx0, dy1, dx1))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_series": f"""WITH {_VIEWS}, {_SERIES} SELECT title, '2019-' || lpad(CAST(m AS VARCHAR), 2, '0') AS year_month, round(v, 6) AS views, n AS n_readings, status
            FROM (SELECT title, m, y AS v, n, 'observed' AS status FROM knot UNION ALL SELECT title, m, v, 0, CASE WHEN v IS NULL THEN 'gap' ELSE 'filled' END FROM gone)""",
        "p7_regions": f"""WITH {_POSITIONS}, {_ZONES} SELECT title, region FROM pos JOIN edge ON (y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 GROUP BY title, region HAVING count(*) % 2 = 1""",
        "p4_found": f"WITH {_VIEWS} SELECT title, '2019-' || lpad(CAST(m AS VARCHAR), 2, '0') AS year_month FROM grid WHERE (title, m) NOT IN (SELECT (title, m) FROM seen)",
        "p5_found": f"WITH RECURSIVE {_TREE} SELECT category, tree_root, CAST(tree_depth AS BIGINT) AS tree_depth FROM tree",
        "p5_paths": f"""WITH RECURSIVE {_TREE}, above AS (
              SELECT up.node, string_agg(up.anc, '/' ORDER BY a.tree_depth) AS way FROM up JOIN tree a ON a.category = up.anc JOIN tree t ON t.category = up.node WHERE t.tree_depth > 0 GROUP BY up.node)
            SELECT category, tree_root, CAST(tree_depth AS BIGINT) AS tree_depth, CASE WHEN tree_depth > 0 THEN way || '/' || category WHEN tree_depth = 0 THEN category END AS path
            FROM tree LEFT JOIN above ON above.node = category""",
        "p5_descendants": f"WITH RECURSIVE {_TREE} SELECT up.anc AS category, up.node AS descendant, CAST(t.tree_depth - a.tree_depth AS BIGINT) AS steps"
        " FROM up JOIN tree t ON t.category = up.node JOIN tree a ON a.category = up.anc WHERE t.tree_depth >= 0",
        "p7_found": f"""WITH {_POSITIONS},
            d AS (SELECT a.title AS title_a, b.title AS title_b,
              pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
              FROM pos a JOIN pos b ON a.title < b.title)
            SELECT title_a, title_b FROM d WHERE 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) <= 1.0""",
    }
