"""Leave-one-out dispersions of large categories: interpolated sums against all pairs."""

import math
import random

from pyspark.sql import functions as F

from atlaswright.operators import category_stats


def test_large_categories_against_all_pairs(spark):
    rng = random.Random(5)
    spots = {f"g{k}": (rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(900)}
    spots |= {f"n{k}": (rng.gauss(48, 0.5), rng.gauss(11, 0.5)) for k in range(700)}
    spots |= {f"h{k}": (48.0, 11.0) for k in range(60)} | {f"p{k}": (rng.uniform(-90, -89), rng.uniform(-180, 180)) for k in range(100)}
    spots |= {f"c{k}": (47.9 + k * 1e-5, 11.1) for k in range(50)} | {f"o{k}": (-48.0 - k * 1e-4, -169.0) for k in range(50)}
    rows = [(t, c) for t in spots for c in ("all", t[0], "some" if t[0] in "nhco" else None) if c]
    rows += [("lost", "all"), (None, "all")]
    cats = spark.createDataFrame(rows, "title string, category string")
    pos = spark.createDataFrame([(t, *p) for t, p in spots.items()], "title string, lat double, lon double")
    ask = cats.where("title is not null and hash(title) % 3 <> 0")
    for requests in (None, ask):
        slow = category_stats.leave_one_out_dispersions(cats, pos, requests, direct=1 << 30)
        fast = category_stats.leave_one_out_dispersions(cats, pos, requests, direct=90)
        assert "sums" in fast._jdf.queryExecution().toString()
        both = slow.join(fast.withColumnRenamed("dispersion", "other"), ["category", "title"], "full")
        got = both.agg(F.count("*").alias("n"), F.count("other").alias("m"), F.count("dispersion").alias("k"), F.max(F.abs(F.col("dispersion") - F.col("other"))).alias("off")).first()
        assert got.n == got.m == got.k > 2000 and got.off < 1e-9, got


def test_requester_view_of_a_large_category(spark):
    rng = random.Random(6)
    spots = {f"t{k}": (rng.uniform(-60, 60), rng.uniform(-170, 170)) for k in range(600)}
    cats = spark.createDataFrame([(t, "C") for t in spots] + [("t1", "D")], "title string, category string")
    pos = spark.createDataFrame([(t, *p) for t, p in spots.items()], "title string, lat double, lon double")
    view = category_stats.requester_view(cats, cats, pos)
    assert "sums" in view._jdf.queryExecution().toString()  # not quadratic
    got = {(r.category, r.title): r for r in view.collect()}
    rad = math.radians
    for t in ("t0", "t1", "t599"):
        others = [p for k, p in spots.items() if k != t]
        y, x = (round(sum(p[i] for p in others) / 599, 9) for i in (0, 1))
        h = lambda p: math.sin(rad(p[0] - y) / 2) ** 2 + math.cos(rad(y)) * math.cos(rad(p[0])) * math.sin(rad(p[1] - x) / 2) ** 2
        want = sum(2 * 6371 * math.atan2(math.sqrt(h(p)), math.sqrt(1 - h(p))) for p in others) / 599
        assert abs(got["C", t].dispersion - want) < 1e-6 and got["C", t].n_located == 599
    assert len(got) == 601 and got["D", "t1"].dispersion is None


def _spots(rng):
    spots = {f"g{k}": (rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(500)} | {f"n{k}": (rng.gauss(48, 0.5), rng.gauss(11, 0.5)) for k in range(300)}
    spots |= {f"h{k}": (48.0, 11.0) for k in range(60)} | {f"p{k}": (rng.uniform(-90, -89), rng.uniform(-180, 180)) for k in range(60)}
    return spots | {f"o{k}": (-48.0 - k * 1e-4, -169.0) for k in range(50)}


def _km(p, q):
    (a, b), (c, d) = (map(math.radians, v) for v in (p, q))
    h = min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_requester_view_in_several_groups(spark):
    """Rows go to their category in one shuffle, whole or divided; both give what all pairs give."""
    rng = random.Random(7)
    spots = _spots(rng)
    rows = [(t, c) for t in spots for c in ("all", t[0], f"m{int(t[1:]) % 40}")] + [(f"x{k}", c) for k in range(500) for c in ("all", "few")] + [("g1", "few"), ("g2", "few"), ("g2", "few"), (None, "few")]
    cats = spark.createDataFrame(rows, "title string, category string")
    pos = spark.createDataFrame([(t, *p) for t, p in spots.items()] + [("x1", None, 2.0)], "title string, lat double, lon double")
    ask = spark.createDataFrame([("g1", "few"), ("x0", "few"), ("x3", "n"), ("x3", "all"), ("g7", "n"), (None, "o"), ("g1", "none"), *[(t, "all") for t in spots]], "title string, category string")
    want = {}
    for title, category in {(r.title, r.category) for r in ask.collect()} - {("g1", "none")}:
        named = [t for t, c in rows if c == category and t is not None]
        member = title in named and title in spots
        placed = [spots[t] for t in sorted({t for t in named if t in spots} - ({title} if member else set()))]
        y, x = (math.floor(sum(round(p[i] * 1e12) for p in placed) / len(placed) / 1000 + 0.5) / 1e9 for i in (0, 1))
        want[category, title] = (y, x, sum(_km(p, (y, x)) for p in placed) / len(placed), len(placed), len(placed) / (len(named) - member + 1))
    for crowded in (20_000, 300, 30):
        view = category_stats.requester_view(ask, cats, pos, crowded=crowded)
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == plan.count("Exchange hash") - plan.count("Exchange hashpartitioning(category") == 1 and "BroadcastNested" not in plan
        got = {(r.category, r.title): r[2:] for r in view.collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert all(abs(a - b) < 1e-8 for a, b in zip(got[k], w)), (crowded, k, got[k], w)


def test_requester_view_is_not_quadratic(monkeypatch):
    import numpy as np

    from atlaswright.operators import category_view as v

    rng, n, met = np.random.default_rng(1), 5000, []
    km = v._km
    monkeypatch.setattr(v, "_km", lambda p, q: met.append((d := km(p, q)).size) or d)
    lat, lon = rng.uniform(-60, 60, n), rng.uniform(-170, 170, n)
    own = v._others(lat, lon, (lat.sum() - lat) / (n - 1), (lon.sum() - lon) / (n - 1), np.ones(n, bool))
    assert sum(met) < 100 * n
    for k in (0, 77, 4999):
        at = ((lat.sum() - lat[k]) / (n - 1), (lon.sum() - lon[k]) / (n - 1))
        assert abs(own[k] - sum(_km((lat[j], lon[j]), at) for j in range(n) if j != k)) / n < 1e-9
