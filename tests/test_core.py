"""Regular grids, hierarchies and proximity against brute force, with awkward rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaswright.operators.hierarchy import category_hierarchy, descendants, hierarchies
from atlaswright.operators.proximity import current_positions, points_in_regions, points_within
from atlaswright.operators.regular_grid import monthly_views, regular_grid


def pchip(xs, ys, x):
    """Plain monotone cubic interpolation of one segment."""
    n = len(xs)
    h, d = np.diff(xs).astype(float), np.diff(ys) / np.diff(xs)
    if n == 2:
        return ys[0] + d[0] * (x - xs[0])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    m = [end(h[0], h[1], d[0], d[1])]
    for k in range(1, n - 1):
        a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
        m.append(0.0 if d[k - 1] * d[k] <= 0 else (a + b) / (a / d[k - 1] + b / d[k]))
    m.append(end(h[-1], h[-2], d[-1], d[-2]))
    k = max(i for i in range(n - 1) if xs[i] <= x)
    u = (x - xs[k]) / h[k]
    return (1 + 2 * u) * (1 - u) ** 2 * ys[k] + u * (1 - u) ** 2 * h[k] * m[k] + u * u * (3 - 2 * u) * ys[k + 1] + u * u * (u - 1) * h[k] * m[k + 1]


def expected_grid(points, max_gap):
    by = {}
    for t, v in points:
        by.setdefault(t, []).append(v)
    knots = sorted((t, sum(v) / len(v)) for t, v in by.items())
    out = {t: (v, "observed") for t, v in knots}
    segments, cur = [], [knots[0]]
    for a, b in zip(knots, knots[1:]):
        if b[0] - a[0] > max_gap + 1:
            segments.append(cur)
            cur = []
            out |= {t: (None, "gap") for t in range(a[0] + 1, b[0])}
        cur.append(b)
    segments.append(cur)
    for s in segments:
        xs, ys = [t for t, _ in s], [v for _, v in s]
        out |= {t: (pchip(xs, ys, t), "filled") for a, b in zip(xs, xs[1:]) for t in range(a + 1, b)}
    return out


@pytest.mark.parametrize("max_gap", [0, 1, 3])
def test_grid_against_brute_force(spark, max_gap):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in "abc":
        pts = [(int(t), float(v)) for t, v in zip(np.sort(rng.choice(120, 45)), rng.normal(0, 9, 45))]
        rows += [(key, t, v) for t, v in pts]
        want |= {(key, t): x for t, x in expected_grid(pts, max_gap).items()}
    rows += [("a", 3, None), ("a", None, 1.0), ("a", 200, math.nan), (None, 1, 1.0), ("only_null", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.period): (r.value, r.status) for r in regular_grid(df, ["k"], F.col("t"), F.col("v"), max_gap, shard_len=9).collect()}
    assert got.keys() == want.keys()
    for key, (v, status) in want.items():
        assert got[key][1] == status
        assert (v is None and got[key][0] is None) or abs(v - got[key][0]) < 1e-9


def test_grid_empty(spark):
    df = spark.createDataFrame([], "k string, t int, v double")
    assert regular_grid(df, ["k"], F.col("t"), F.col("v")).count() == 0


def test_monthly_views(spark):
    at = lambda m, d=1: dt.datetime(2019, m, d, tzinfo=dt.timezone.utc)
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    rows = [
        ("T", old, [(at(1), 1.0), (at(4), None), (at(2), -1.0), (None, 5.0)]), ("T", new, [(at(4), 7.0), (at(1), 3.0)]), ("T", new, None), ("T", new, []),
        ("T", old, [(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), 4.0), (at(3), math.nan)]), (None, old, [(at(1), 1.0)]), ("U", old, [(at(5), 0.0), (at(5, 20), 4.0), (at(5, 20), 4.0)]),
    ]
    df = spark.createDataFrame(rows, "title string, fetched_at timestamp, items array<struct<stamp timestamp, views double>>")
    got = {(r.title, r.year_month): (r.views, r.n_readings, r.status) for r in monthly_views(df).collect()}
    assert got[("T", "2019-01")] == (3.0, 1, "observed") and got[("T", "2019-04")] == (7.0, 1, "observed") and got[("U", "2019-05")] == (2.0, 2, "observed")
    assert {k for k, v in got.items() if v[2] != "observed"} == {("T", "2019-02"), ("T", "2019-03")}


def brute_tree(nodes, links):
    par = {}
    for a, b in links:
        if a and b:
            par.setdefault(b, set()).add(a)
    every = {x for x in nodes if x} | {x for e in links if e[0] and e[1] for x in e}

    def above(n, seen):
        for p in par.get(n, ()):
            if p not in seen:
                seen.add(p)
                above(p, seen)
        return seen

    looped = {n for n in every if n in above(n, set())}
    memo = {}

    def best(n):
        if n not in memo:
            ups = [best(p) for p in par.get(n, ())]
            memo[n] = min(((-(d + 1), r) for r, d in ups), default=(0, n))
            memo[n] = (memo[n][1], -memo[n][0])
        return memo[n]

    return {n: ("", -1) if n in looped or above(n, set()) & looped else best(n) for n in every}


TREES = {
    "chain": [(f"n{k}", f"n{k + 1}") for k in range(40)],
    "star and chain": [("r", f"a{k}") for k in range(30)] + [("a1", "b"), ("b", "c"), ("c", "d")],
    "loops": [("a", "a"), ("a", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "v"), ("top", "mid"), ("mid", "x"), ("mid", "leaf"), ("p", "q"), ("q", "p")],
    "several parents": [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "e"), ("e", "c"), ("s", "d"), ("s", "t"), ("t", "u"), ("u", "d")],
    "peeled from above": [("r", "a"), ("r", "b"), ("a", "l1"), ("b", "l1"), ("l1", "l2"), ("l2", "l1"), ("b", "ok"), ("a", "ok"), ("l2", "under"), ("ok", "kid"), ("r2", "b"), ("b", "c2"), ("c2", "l2")],
    "awkward": [(None, "a"), ("a", None), ("a", "b"), ("a", "b"), ("", "c")],
    "empty": [],
}


@pytest.mark.parametrize("name", TREES)
def test_hierarchies(spark, name):
    links = TREES[name]
    df = spark.createDataFrame(links, "parent string, child string")
    nodes = spark.createDataFrame([("lonely",), (None,)], "node string")
    got = {r.node: (r.root, r.depth) for r in hierarchies(nodes, df).collect()}
    want = brute_tree(["lonely"], [e for e in links if e[0] is not None and e[1] is not None and e[0] != ""])
    if name == "awkward":
        want |= {"": ("", 0), "c": ("", 1)}
    assert got == want


def test_contraction_in_rounds(spark):
    """All of these, and a mesh of ten links up and down above a loop, with no link left to a single task."""
    links = [(f"{name[:2]} {a}", f"{name[:2]} {b}") for name, tree in TREES.items() if name != "awkward" for a, b in tree]
    links += [(f"a{k}{i}", f"a{k + 1}{j}") for k in range(3) for i in range(10) for j in range(10)] + [(f"a3{i}", "p") for i in range(10)] + [("p", "q"), ("q", "p")]
    df = spark.createDataFrame(links, "parent string, child string")
    got = {r.node: (r.root, r.depth) for r in hierarchies(df.select(F.col("child").alias("node")), df, finish=0).collect()}
    assert got == brute_tree([], links)


def test_deep_layers_of_two(spark):
    """200 layers of two nodes, each linked to both of the next layer; below them a leaf, or a loop with a leaf."""
    links = [(f"{g}{a}{k:03}", f"{g}{b}{k + 1:03}") for g in "mn" for k in range(199) for a in "xy" for b in "xy"]
    links += [("nx199", "l"), ("l", "m"), ("m", "l"), ("m", "end")] + [("mx199", "leaf")]
    df = spark.createDataFrame(links, "parent string, child string")
    got = {r.node: (r.root, r.depth, r.path) for r in hierarchies(df.select(F.col("child").alias("node")), df, paths=True, finish=100).collect()}
    assert len(got) == 804 and got["my199"][:2] == ("mx000", 199) and got["nx150"][2] == [f"nx{k:03}" for k in range(151)]
    assert got["leaf"][:2] == ("mx000", 200) and got["end"] == got["l"] == got["m"] == ("", -1, None)


def test_paths_and_descendants(spark):
    rows = [(1, "Category: A ", ["B|x", "[]"]), (2, "B", ["C c", None, "C+c"]), (3, "D", []), (4, None, ["E"]), (5, "F", ["category:F"]), (6, "F", None)]
    df = spark.createDataFrame(rows, "counter int, category string, subcategories array<string>")
    t = category_hierarchy(df, paths=True)
    got = {r.category: (r.tree_root, r.tree_depth, r.path) for r in t.collect()}
    assert got["C_c"] == ("A", 2, ["A", "B", "C_c"]) and got["D"] == ("D", 0, ["D"]) and got["E"] == ("E", 0, ["E"]) and got["F"] == ("", -1, None)
    assert {(r.category, r.descendant, r.steps) for r in descendants(t).collect() if r.category == "A"} == {("A", "B", 1), ("A", "C_c", 2), ("A", "[]", 1)}


def brute_pairs(points, km):
    p = sorted({(i, a, b) for i, a, b in points if i is not None and a is not None and b is not None and not math.isnan(a) and not math.isnan(b) and abs(a) <= 90 and abs(b) <= 180})
    out = set()
    for x in p:
        for y in p:
            if x[0] < y[0]:
                h = math.sin(math.radians(y[1] - x[1]) / 2) ** 2 + math.cos(math.radians(x[1])) * math.cos(math.radians(y[1])) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2
                if 2 * 6371 * math.asin(math.sqrt(min(1, h))) <= km:
                    out.add((x[0], y[0]))
    return out


@pytest.mark.parametrize("km", [1.0, 40.0, 3000.0])
def test_points_within(spark, km):
    rng = np.random.default_rng(5)
    spread = km / 111
    pts = [(f"p{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(rng.normal(50, spread, 120), rng.normal(10, spread, 120)))]
    pts += [(f"q{k}", float(np.clip(90 - abs(a), -90, 90)), float(b)) for k, (a, b) in enumerate(zip(rng.normal(0, spread, 60), rng.uniform(-180, 180, 60)))]
    pts += [(f"d{k}", float(a), float((180 + b + 180) % 360 - 180)) for k, (a, b) in enumerate(zip(rng.normal(-3, spread, 60), rng.normal(0, spread, 60)))]
    pts += [("e1", 0.5, 180.0), ("e2", 0.5, -180.0), ("same", 0.5, 180.0), ("s1", -90.0, 0.0), ("s2", -90.0, 100.0), ("same", 0.5, 180.0)]
    pts += [(None, 1.0, 1.0), ("n", None, 1.0), ("nan", math.nan, 1.0), ("far", 91.0, 1.0)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    got = [tuple(r) for r in points_within(df, "id", "lat", "lon", km, dense=6, levels=3, block=5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(pts, km)


def test_points_within_empty(spark):
    assert points_within(spark.createDataFrame([], "id string, lat double, lon double"), "id", "lat", "lon", 1.0).count() == 0


def test_current_positions(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [("a", 1.0, 1.0, t(1)), ("a", 2.0, 2.0, t(3)), ("a", None, 2.0, t(4)), ("a", 0.0, 0.0, t(5)), ("b", 91.0, 1.0, t(1)), ("c", 3.0, 3.0, None), (None, 1.0, 1.0, t(1)), ("d", math.nan, 1.0, t(1)), ("a", 2.0, 2.0, t(3))]
    got = {r.title: (r.lat, r.lon) for r in current_positions(spark.createDataFrame(rows, "title string, lat double, lon double, revised_at timestamp")).collect()}
    assert got == {"a": (2.0, 2.0), "c": (3.0, 3.0)}


def test_points_in_regions(spark):
    rng = np.random.default_rng(9)
    star = [(10 + (6 if k % 2 else 14) * math.sin(k * math.pi / 6), 20 + (6 if k % 2 else 14) * math.cos(k * math.pi / 6)) for k in range(12)]
    box = [(0.0, 0.0), (0.0, 30.0), (15.0, 30.0), (15.0, 0.0)]
    regions = spark.createDataFrame([("star", star), ("box", box), ("bad", [(0.0, 0.0)]), (None, box), ("null", None)], "region string, ring array<struct<lat double, lon double>>")
    pts = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-10, 30, 600), rng.uniform(-5, 45, 600)))]

    def inside(y, x, ring):
        odd = False
        for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
        return odd

    want = {(k, n) for k, a, b in pts for n, ring in (("star", star), ("box", box)) if inside(a, b, ring)}
    df = spark.createDataFrame([*pts, (None, 1.0, 1.0), (9999, None, 1.0), (0, pts[0][1], pts[0][2])], "id int, lat double, lon double")
    got = [tuple(r) for r in points_in_regions(df, regions, cell_deg=4.0, levels=3, block=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_clashing_columns(spark):
    df = spark.createDataFrame([("k", 1, 2.0, 7, "x"), ("k", 3, 4.0, 7, "x")], "k string, t int, v double, period int, status string")
    assert [(r.period, r.value) for r in regular_grid(df, ["k"], F.col("t"), F.col("v")).orderBy("period").collect()] == [(1, 2.0), (2, 3.0), (3, 4.0)]
    pts = spark.createDataFrame([("a", 1.0, 1.0, 5, 6, True), ("b", 1.0, 1.0, 5, 6, True)], "id string, lat double, lon double, band int, col int, dense boolean")
    assert [tuple(r) for r in points_within(pts, "id", "lat", "lon", 1.0).collect()] == [("a", "b")]
    links = spark.createDataFrame([("a", "b", 1, "r")], "parent string, child string, steps int, root string")
    assert {r.node: r.depth for r in hierarchies(spark.createDataFrame([("a", 3)], "node string, depth int"), links).collect()} == {"a": 0, "b": 1}


def test_one_source_with_most_readings_spreads(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("k"), (F.col("id") % 2500).alias("t"), F.col("id").cast("double").alias("v"))
    got = regular_grid(df, ["k"], F.col("t"), F.col("v"), shard_len=16)
    assert got.where("k = 'hot'").count() == 2500 and got.where("status <> 'observed'").count() == 0
