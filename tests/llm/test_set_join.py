"""Set similarity joins against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlaswright.llm.set_join import classes, expand, feature_rows, join_group, merge_skip, numbered_values, similar_sets, t_occurrence


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12).map(lambda x: sorted(set(x))), max_size=7), st.integers(1, 5), st.integers(1, 31))
def test_t_occurrence(lists, need, end):
    want = {v: sum(v in a for a in lists) for v in range(end) if sum(v in a for a in lists) >= need}
    assert dict(merge_skip(lists, need, end)) == want
    assert dict(t_occurrence(lists, need, end)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 9), min_size=3), min_size=1, max_size=12), st.sampled_from([0.4, 0.6, 0.8]))
def test_join_group(sets, t):
    records = [(len(s), f"r{k:02}", 0, "", sorted(s)) for k, s in enumerate(sets)]
    want = {(f"r{a:02}", f"r{b:02}") for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}
    assert set(join_group(records, t, False)) == want


def brute(rows, t, least, cross=False):
    sets = {}
    for part, side, rec, val in rows:
        if None not in (part, rec, val):
            sets.setdefault((part, rec), [side, set()])[1].add(val)
    keys = [k for k, (_, s) in sets.items() if len(s) >= least]
    out = set()
    for a in keys:
        for b in keys:
            x, y = sets[a], sets[b]
            if a[0] == b[0] and a[1] < b[1] and (not cross or x[0] != y[0]) and len(x[1] & y[1]) >= t * len(x[1] | y[1]) - 1e-9:
                out.add((a[0], a[1], b[1]))
    return out


def make(seed, n, hot):
    """Sets around common cores; most hold the hot values, many only differ in one."""
    r = random.Random(seed)
    cores = [r.sample(range(60), 6) for _ in range(12)]
    rows = []
    for k in range(n):
        s = set(r.choice(cores)) if r.random() < 0.7 else set(r.sample(range(60), r.randint(1, 8)))
        s = {v for v in s if r.random() < 0.9} | {x for x in hot if r.random() < 0.8}
        rows += [("f" if k % 2 else "g", "l" if k % 3 else "r", f"t{k:03}", f"v{v}") for v in s]
    return rows + rows[:20]


SCHEMA = "part string, side string, record string, value string"


@pytest.mark.parametrize(("block", "least", "t"), [(2000, 3, 0.6), (5, 3, 0.6), (2, 3, 0.6), (3, 1, 0.5)])
def test_similar_sets(spark, block, least, t):
    rows = make(block, 120, [100, 101, 102]) + [(None, "", "x", "v1"), ("f", "", None, "v1"), ("f", "", "x", None)]
    pairs, members = similar_sets(spark.createDataFrame(rows, SCHEMA), t, least, block=block)
    got = [tuple(r) for r in expand(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t, least)
    links = {}
    for part, a, b in got:
        for x in (a, b):
            links[(part, x)] = links.get((part, x), 0) + 1
    per = {(r.part, r.record): r.links for r in classes(pairs, members).collect()}
    assert {k: v for k, v in per.items() if v} == links


def test_two_tables(spark):
    rows = make(1, 90, [100])
    pairs, members = similar_sets(spark.createDataFrame(rows, SCHEMA), 0.6, 3, cross=True, block=6)
    m = members.select("part", "class", "side", "record")
    named = pairs.join(m.select("part", F.col("class").alias("class_a"), F.col("side").alias("sa"), F.col("record").alias("a")), ["part", "class_a"]).join(m.select("part", F.col("class").alias("class_b"), F.col("side").alias("sb"), F.col("record").alias("b")), ["part", "class_b"])
    got = {(r.part, min(r.a, r.b), max(r.a, r.b)) for r in named.where("sa <> sb").collect()}
    assert got <= brute(rows, 0.6, 3, cross=True)
    same = {(r.part, frozenset(x)) for r in m.groupBy("part", "class").agg(F.collect_set("record").alias("x")).collect() for x in [r.x]}
    assert same
    alike = {p for p in brute(rows, 0.6, 3, cross=True)}
    sets = {}
    for part, _, rec, val in rows:
        sets.setdefault((part, rec), set()).add(val)
    assert {p for p in alike if sets[(p[0], p[1])] != sets[(p[0], p[2])]} <= got


def test_empty_and_readings(spark):
    pairs, members = similar_sets(spark.createDataFrame([], SCHEMA))
    assert expand(pairs, members).count() == 0
    cats = spark.createDataFrame([("A", "Category : x y|k"), ("A", " x+y "), ("A", "#"), ("A", None), (None, "z")], "title string, category string")
    locs = spark.createDataFrame([("A", "_P q ", 1, 0), ("A", "R", 0, 0), ("A", "S", None, 0), ("A", " _ ", 2, 0)], "title string, location string, cnt int, ord int")
    got = {(r.part, r.record, r.value) for r in feature_rows(cats, locs).where("value is not null and record is not null").collect()}
    assert got == {("categories", "A", "x_y"), ("named_locations", "A", "P_q")}


def test_values_whose_hashes_are_equal(spark):
    rows = [("f", "", f"r{k % 7}", f"v{k}") for k in range(40)]
    got = numbered_values(spark.createDataFrame(rows, SCHEMA), bits=3)
    assert got.count() == 40 and got.select("v").distinct().count() == 40
    same = numbered_values(spark.createDataFrame(rows + rows, SCHEMA))
    assert same.count() == 80 and same.select("v").distinct().count() == 40


def test_equal_sets_of_many_records(spark):
    rows = [("f", "", f"r{k:04}", v) for k in range(300) for v in ("a", "b", "c")] + [("f", "", "near", v) for v in ("a", "b", "c", "d")]
    pairs, members = similar_sets(spark.createDataFrame(rows, SCHEMA), most=50)
    for most in (2000, 50):
        assert expand(pairs, members, most).distinct().count() == 300 * 299 // 2 + 300
    assert {r.links for r in classes(pairs, members).collect()} == {300}
