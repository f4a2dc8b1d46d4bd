"""Rank fusion, term weights and top N against plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from atlaswright.llm.distinctive import leading_terms, term_weights, usable_counts
from atlaswright.llm.rank_fusion import _brackets, candidate_ranking, exact_medians, fuse_scores
from atlaswright.llm.top_n import kept_neighbors, top_n


def test_exact_medians(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0.0, -1.5, 2.0, r.gauss(0, 5), r.gauss(0, 1e-6), r.gauss(1e9, 1)]), r.random() if r.random() < 0.5 else None) for k in ["a", "b", "c"] for _ in range(r.randint(1, 200))]
    rows += [("one", 7.0, None)] + [("offset", 1e9 + r.random(), 3.0) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    near = _brackets(df, ["x", "y"], 500)
    assert {x.g: x.salts for x in near.collect()}["offset"] == 6
    salted = df.join(near.select("g", "salts"), "g").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).drop("salts")
    narrow = near.withColumn("hi_x", F.col("lo_x") - 1)  # as if a sketch had missed the middle
    for brackets in (near, narrow):
        got = {x.g: (x.m_x, x.m_y) for x in exact_medians(salted, ["x", "y"], brackets).collect()}
        mid = lambda v: statistics.median(v) if v else None
        want = {k: (mid([x for q, x, _ in rows if q == k]), mid([y for q, _, y in rows if q == k and y is not None])) for k in {q for q, *_ in rows}}
        assert {k: tuple(v and round(v, 9) for v in m) for k, m in got.items()} == {k: tuple(v and round(v, 9) for v in m) for k, m in want.items()}


def plain_fusion(rows):
    groups = {}
    for g, i, *xs in set(rows):
        if g is not None and i is not None and g != i:
            groups.setdefault(g, []).append((i, [None if x is None or math.isnan(x) else x for x in xs]))
    out = {}
    for g, items in groups.items():
        stats = []
        for k in range(3):
            v = [xs[k] for _, xs in items if xs[k] is not None]
            m = statistics.median(v) if v else None
            d = [abs(x - m) for x in v]
            s = statistics.median(d) * 1.4826 if v else 0
            stats.append((m, s or (sum(d) / len(d) * 1.2533 if v else 0)))
        score = {}
        for i, xs in items:
            f = p = 0.0
            for x, (m, s) in zip(xs, stats):
                z = max(-600, min(600, (x - m) / s)) if x is not None and s > 0 else 0.0
                f += (-700 if x is None else -math.log1p(math.exp(-z)) if z > -30 else z) / 3
                p += (-700 if x is None else z) / 3
            score[i] = max(score.get(i, (-1e9, -1e9)), (f, p))
        out[g] = sorted(score, key=lambda i: (-score[i][0], -score[i][1], i))
    return out


def test_fusion(spark):
    r = random.Random(2)
    rows = [(f"g{k % 3}", f"i{r.randint(0, 60)}", r.random() ** 3, r.gauss(5e5, 1e5) if r.random() < 0.9 else None, float(r.randint(0, 4)) if r.random() < 0.9 else math.nan) for k in range(240)]
    rows += [("g0", "g0", 9.0, 9e9, 9.0), (None, "i1", 1.0, 1.0, 1.0), ("g0", None, 1.0, 1.0, 1.0), ("solo", "x", None, None, None), ("flat", "b", 1.0, 1.0, 1.0), ("flat", "a", 1.0, 1.0, 1.0)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "title string, neighbor string, tf_idf double, named_locations double, categories double")
    rows = [tuple(math.nan if isinstance(x, float) and math.isnan(x) else x for x in row) for row in rows]
    want = plain_fusion({tuple(None if isinstance(x, float) and math.isnan(x) else x for x in row) for row in rows})
    ranked = candidate_ranking(df).orderBy("title", "rank").collect()
    got = {}
    for x in ranked:
        got.setdefault(x.title, []).append(x.neighbor)
        assert x.rank == len(got[x.title])
    assert got == want and got["flat"] == ["a", "b"]
    first = {x.title: x.neighbor for x in candidate_ranking(df, keep=1).collect()}
    assert first == {g: i[0] for g, i in want.items()}
    with pytest.raises(ValueError):
        fuse_scores(df, "title", "neighbor", {"tf_idf": -1.0})
    assert candidate_ranking(df.limit(0)).count() == 0


def test_large_range_does_not_dominate(spark):
    rows = [("t", f"i{k}", 0.5 + 0.001 * k, 1e6 - k, float(k % 2)) for k in range(20)] + [("t", "best", 0.9, 1e6 + 1, 3.0), ("t", "huge", 0.1, 9e9, 0.0)]
    df = spark.createDataFrame(rows, "title string, neighbor string, tf_idf double, named_locations double, categories double")
    assert candidate_ranking(df, keep=1).first()["neighbor"] == "best"


def test_term_weights(spark):
    rows = [("A", "Lake", 2), ("A", "lake", 2), ("A", "rare", 2), ("B", "lake", 9), ("B", "only", 1), ("C", "lake", 1), ("C", "zz", 3), ("C", "zy", 3)]
    rows += [("A", None, 3), (None, "x", 3), ("A", "", 3), ("A", "bad", 0), ("A", "bad", None), ("A", "bad", -2), ("C", "zz", 3)]
    counts = usable_counts(spark.createDataFrame(rows, "title string, word string, tf int"))
    assert {(r.record, r.term): r.tf for r in counts.collect()}[("A", "lake")] == 2
    w = {(r.record, r.term): r.weight for r in term_weights(counts).collect()}
    p = [2 / 12, 9 / 12, 1 / 12]
    lake = 1 + sum(x * math.log(x) for x in p) / math.log(3)
    assert abs(w[("B", "lake")] - math.log(10) * lake) < 1e-12 and abs(w[("A", "rare")] - math.log(3)) < 1e-12
    assert {r.record: r.term for r in leading_terms(term_weights(counts)).collect()} == {"A": "rare", "B": "lake" if w[("B", "lake")] > math.log(2) else "only", "C": "zy"}
    assert term_weights(counts.where("record = 'A'")).where("global_weight <> 1").count() == 0
    assert leading_terms(term_weights(counts.limit(0))).count() == 0


@pytest.mark.parametrize("n", [3, 10, 1, 40])
def test_top_n(spark, n):
    r = random.Random(n)
    rows = [("hot", f"i{r.randint(0, 900):03}", r.choice([0.5, 0.25, round(r.random(), 2)])) for _ in range(3000)] + [(f"g{k % 40}", f"i{k}", r.random()) for k in range(200)]
    rows += [("ties", f"i{k:03}", 0.5) for k in range(300)] + [("hot", None, 1.0), (None, "i", 1.0), ("hot", "nan", math.nan), ("hot", "null", None), ("neg", "a", -1.0)]
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and not math.isnan(s):
            best[(g, i)] = max(s, best.get((g, i), s))
    want = {}
    for (g, i), s in sorted(best.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if len(want.setdefault(g, [])) < n:
            want[g].append((i, s))
    got = {}
    for x in top_n(spark.createDataFrame(rows, "g string, i string, s double"), "g", "i", "s", n, salts=3).orderBy("g", "rank").collect():
        got.setdefault(x.g, []).append((x.i, x.s))
        assert x["rank"] == len(got[x.g])
    assert got == want


def test_kept_neighbors(spark):
    rows = [("a", "b", 0.1, 1), ("a", "a", 0.9, 1), ("a", "c", 0.09, 1), ("a", "d", math.nan, 1), ("a", "b", 0.4, 2)]
    got = kept_neighbors(spark.createDataFrame(rows, "title string, neighbor string, score double, rank int")).collect()
    assert [(r.title, r.neighbor, r.score) for r in got] == [("a", "b", 0.4)]
    assert kept_neighbors(spark.createDataFrame([], "title string, neighbor string, score double")).count() == 0


def test_clashing_columns(spark):
    counts = spark.createDataFrame([("A", "x", 2, 9, 9.0), ("B", "y", 1, 9, 9.0)], "record string, term string, tf long, df long, weight double")
    assert {r.record: r.df for r in term_weights(counts).collect()} == {"A": 1, "B": 1}
    scores = spark.createDataFrame([("t", "i", 1.0, 2.0, 3.0, 4, 5.0)], "title string, neighbor string, tf_idf double, named_locations double, categories double, rank int, fused double")
    assert candidate_ranking(scores).first()["rank"] == 1


def test_order_of_rows_decides_nothing(spark):
    r = random.Random(5)
    words = [(f"R{k}", t, n) for k in range(60) for t, n in ((f"a{k % 12}", k % 5 + 1), (f"b{k % 12}", k % 5 + 1))]  # a and b have equal counts everywhere
    scores = [(f"t{k % 3}", f"i{k % 40:02}", float(r.randint(0, 3)), float(r.randint(0, 3)), 1.0) for k in range(240)]
    seen = set()
    for parts in (1, 3, 7):
        w = spark.createDataFrame(r.sample(words, len(words)), "title string, word string, tf int").repartition(parts)
        lead = sorted(map(tuple, leading_terms(term_weights(usable_counts(w))).select("record", "term").collect()))
        assert all(t.startswith("a") for _, t in lead)
        s = spark.createDataFrame(r.sample(scores, len(scores)), "title string, neighbor string, tf_idf double, named_locations double, categories double").repartition(parts)
        seen.add((tuple(lead), tuple(map(tuple, candidate_ranking(s).orderBy("title", "rank").select("title", "neighbor", "rank").collect()))))
    assert len(seen) == 1


def test_pruning_by_histogram(spark):
    r = random.Random(6)
    rows = [("one", f"i{k % 500:03}", r.random()) for k in range(4000)] + [("one", "far", 1e12)]  # repeated items and one outlier
    df = spark.createDataFrame(rows, "g string, i string, s double").repartition(3)
    best = {}
    for _, i, s in rows:
        best[i] = max(s, best.get(i, s))
    got = [x.i for x in top_n(df, "g", "i", "s", 10).orderBy("rank").collect()]
    assert got == sorted(best, key=lambda i: (-best[i], i))[:10]
