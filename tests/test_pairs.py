"""Pairs of titles with terms in common, and what may be shuffled for them."""

import math
import random

import pytest

import __spark_entry__ as entry
from atlaswright.operators import neighbors


def above_pairs(df):
    """The operators of a plan above the one that forms pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return plan.split("MapInArrow")[0]


def test_candidate_union_never_shuffles_pairs(spark, sf):
    assert "Exchange" not in above_pairs(entry.queries()["candidate_union"](spark, sf))


def test_posting_prune_k_never_shuffles_pairs(spark, sf):
    assert "Exchange" not in above_pairs(entry.queries()["posting_prune_k"](spark, sf))


@pytest.mark.parametrize("block", [7, 16_384])
def test_pairs_in_common(spark, block):
    rng = random.Random(3)
    held = {f: {f"t{k}": {f"{f[0]}{min(int(rng.expovariate(0.15)), 40)}" for _ in range(n)} for k in range(60)} for f, n in (("words", 9), ("locations", 2), ("categories", 1))}
    located = {f"t{k}" for k in range(60) if k % 3}
    rows = [(f, x, t, t in located) for f, by in held.items() for t, xs in by.items() for x in xs]
    rows += rows[:50] + [("words", None, "t1", True), ("words", "w1", None, True)]
    rows += [("categories", f"alone{k}", f"u{k}", False) for k in range(3)]
    df = spark.createDataFrame(rows, "feature string, term string, title string, has_coords boolean")
    n = {(a, b): [len(held[f][a] & held[f][b]) for f in held] for a in held["words"] for b in located if a != b}
    got = [tuple(r) for r in neighbors.pairs_in_common(df, {"words": 2, "locations": 1, "categories": 1}, block=block).collect()]
    want = sorted(p for p, (w, lo, c) in n.items() if w >= 2 or lo or c)
    assert sorted(got) == want and 0 < len(want) < len(n)
    got = [tuple(r) for r in neighbors.pairs_in_common(df, {"words": 3}, "words", block=block).collect()]
    assert sorted(got) == sorted((*p, w) for p, (w, _, _) in n.items() if w >= 3)
    assert neighbors.pairs_in_common(df.limit(0), {"words": 1}).count() == 0
    with pytest.raises(ValueError):
        neighbors.pairs_in_common(df, {"words": 0})


def test_blocks_give_only_what_can_be_among_the_best(spark):
    rng = random.Random(4)
    rows = []
    for k in range(80):
        x = rng.uniform(0.2, 1.5)
        rows += [("words", "p", k, math.cos(x), True, False), ("words", "q", k, math.sin(x), True, False)]
    df = spark.createDataFrame(rows, "feature string, term string, id long, score double, indexed boolean, extra boolean")
    use, enough = {"words": 1.0, "locations": 0.0, "categories": 0.0}, dict.fromkeys(neighbors.FEATURES, 1)
    every = {(r.a, r.b): r.score for r in neighbors.blocked_pairs(df, use, 0.1, enough, False).collect()}
    some = {(r.a, r.b): r.score for r in neighbors.blocked_pairs(df, use, 0.1, enough, False, most_neighbors=5).collect()}
    best = lambda pairs, a: sorted((-round(s, 9), b) for (x, b), s in pairs.items() if x == a)[:5]
    assert all(best(some, a) == best(every, a) for a in range(80)) and len(some) < len(every) / 4
