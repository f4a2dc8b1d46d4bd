"""Queries over small tables of their own, against plain Python."""

import math
import random
from itertools import product

import __spark_entry__ as entry
import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables (name, schema, rows) and gives their folder."""

    def write(**named):  # noqa: ANN003, ANN202
        for name, (schema, rows) in named.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write


def by_sql(folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    import os

    root = folder.removeprefix("file://")
    for t in os.listdir(root):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{root}/{t}/*.parquet'")
    return con.execute(entry.oracle_sql()[name])


WORDS = ("title string, word string, tf int", [("A", "x", 2), ("A", "y", 1), ("B", "x", 1), ("B", "y", 3), ("C", "x", 1), ("D", "q", 1), ("E", "w", 1), ("F", "v", 1)])
NAMED = ("title string, location string, cnt int, ord int", [("A", "P", 3, 0), ("D", "P", 1, 9), ("C", "Q", 1, 2), ("F", "R", 1, 1)])
CATS = ("title string, category string", [("A", "c1"), ("E", "c1"), ("C", "c2"), ("F", "c2"), ("B", "c3")])
SPOTS = ("title string, lat double, lon double, revised_at timestamp", [(t, 1.0, 1.0, None) for t in "ABCE"])


def test_candidates_of_all_features(spark, tables):
    sf = tables(article_words=WORDS, named_locations=NAMED, categories=CATS, coordinates=SPOTS)
    held = lambda t, k: {r[1] for r in t[1] if r[0] == k}
    want = {
        (a, b) for a, b in product("ABCDEF", "ABCE")
        if a != b and (len(held(WORDS, a) & held(WORDS, b)) >= 2 or held(NAMED, a) & held(NAMED, b) or held(CATS, a) & held(CATS, b))
    }
    got = [tuple(r) for r in entry.queries()["candidate_union"](spark, sf).select("title", "neighbor").collect()]
    assert ("F", "C") in want and ("A", "E") in want and sorted(got) == sorted(want)
    assert sorted(by_sql(sf, "candidate_union").fetchall()) == sorted(want)


def test_postings_of_all_features(spark, tables):
    tied = [("T", f"L{k:02}", 1, 7) for k in range(22)]  # two more than a vector holds, all named by the same word
    sf = tables(article_words=WORDS, named_locations=(NAMED[0], NAMED[1] + tied), categories=CATS, coordinates=SPOTS)
    rows = entry.queries()["postings"](spark, sf).select("feature", "term", "n", "n_located", "first", "points").collect()
    got = {r.term: (r.n, r.n_located, r.first) for r in rows if r.feature == "locations"}
    assert got == {"P": (2, 1, "A"), "Q": (1, 1, "C"), "R": (1, 0, "F")} | {f"L{k:02}": (1, 0, "T") for k in range(20)}
    assert {r.feature for r in rows} == {"words", "locations", "categories"}
    assert sorted(map(tuple, rows)) == sorted(by_sql(sf, "postings").fetchall())


def test_dense_cosines_of_all_pairs(spark, tables):
    rng = random.Random(1)
    vs = {k: [rng.uniform(-1, 1) for _ in range(4)] for k in range(45)}
    odd = [(50, [0.0] * 4), (51, None), (52, [1.0, None, 1.0, 1.0]), (53, [float("nan")] * 4), (54, [1.0, 1.0]), (55, []), (None, [1.0] * 4)]
    sf = tables(embeddings=("vec_id long, embedding array<double>", [*vs.items(), *odd]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = {(a, b): dot(vs[a], vs[b]) / math.sqrt(dot(vs[a], vs[a]) * dot(vs[b], vs[b])) for a in vs for b in vs if a < b}
    want = {k: round(c, 6) for k, c in cos.items() if round(c, 6) >= 0.1}
    got = entry.queries()["cosine_dense"](spark, sf).select("id_a", "id_b", "cosine").collect()
    assert len(got) == len(want) > 300 and all(abs(want[(r.id_a, r.id_b)] - r.cosine) < 2e-6 for r in got)
    assert sorted(map(tuple, got)) == sorted(by_sql(sf, "cosine_dense").fetchall())


def test_distances_among_named_places(spark, tables):
    spots = {"P3": (10.0, 20.0), "P6": (10.5, 21.0), "P9": (-40.0, -160.0), "P0": (0.0, 0.0), "T": (1.0, 1.0)}  # 0/0 is no position
    named = [("T", "P3", 1, 0), ("T", "P6", 2, 3), ("T", "P0", 1, 4), ("T", "lost", 1, 5), ("U", "P3", 1, 0), ("U", "P9", 1, 1), ("V", "lost", 1, 0), ("W", "P9", 1, 0)]
    sf = tables(named_locations=(NAMED[0], named), coordinates=(SPOTS[0], [(t, *p, None) for t, p in spots.items()]))

    def km(a, b):  # noqa: ANN001, ANN202
        if a in ("lost", "P0") or b in ("lost", "P0"):
            return None
        (p, q), (r, s) = (map(math.radians, spots[x]) for x in (a, b))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return round(2 * 6371 * math.asin(math.sqrt(h)), 4)

    rows = lambda name: [r.asDict() for r in entry.queries()[name](spark, sf).collect()]
    got = {(r["title"], r["place_a"], r["place_b"]): r["km"] and round(r["km"], 4) for r in rows("haversine_pairs")}
    assert got == {(t, a, b): km(a, b) for t, a, *_ in named for u, b, *_ in named if t == u and a < b} and len(got) == 7
    assert km("P3", "P9") > 12000
    assert {r["title"]: round(r["diameter"], 4) for r in rows("diameter_filter")} == {"T": km("P3", "P6"), "W": 0.0}


def test_types_of_documents(spark, tables):
    docs = [
        (1, "Byname", "X is a river in Y."), (2, "Boxed", "| settlement_type = Town\nX."), (3, "Said", "Said is an island near Y."), (4, "HMS_X_(ship)", "X."), (5, "Open", "X went."),
        (6, "Said", "Said was a lake of Y."), (7, None, "It is a lake."), (8, "Bare", None), (9, "Left", "Left is a mountain near Y."),
    ]
    cats = [("Byname", "Towns_in_Y"), ("Only", "Rivers_of_Y"), ("Left", "Stubs")]
    sf = tables(documents=("doc_id long, title string, text string, revised_at timestamp", [(*d, None) for d in docs]), categories=(CATS[0], cats))
    got = {(r.doc_id, r.title): r.type for r in entry.queries()["type_of_articles"](spark, sf).collect()}
    assert got == {
        (1, "Byname"): "SETTLEMENT", (2, "Boxed"): "SETTLEMENT", (3, "Said"): "LAND", (4, "HMS_X_(ship)"): "SHIP", (5, "Open"): "NONE", (6, "Said"): "NATURE",
        (8, "Bare"): "NONE", (9, "Left"): "NATURE", (None, "Only"): "NATURE",
    }


def test_augmentation_of_a_long_chain(spark):
    from atlaswright.operators.category_graph import augmented_edges

    chain = {(f"c{k}", f"c{k + 1}") for k in range(55)}
    empty = spark.createDataFrame([], "parent string, child string")
    got = augmented_edges(empty, spark.createDataFrame(sorted(chain), "parent string, child string"), spark.createDataFrame([("c0",)], "name string"))
    assert {tuple(r) for r in got.collect()} == chain
