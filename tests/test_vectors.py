"""Tokens, stems, vectors, neighbours, categories, graphs, weights, writers and streams on small tables."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atlaswright.config import Settings, Weights
from atlaswright.functions.geo import haversine_km
from atlaswright.functions.porter import stem, stemmed
from atlaswright.functions.text import irreducible, occurrences, tokens, upper_first, without_stop_words
from atlaswright.operators import category_graph, category_stats, neighbors, vectors, weights
from atlaswright.sources import readers, writers
from atlaswright.streaming import corpus


def test_weights_parse():
    assert Weights.parse("1/3,1/3,1/3") == Weights() and Weights.parse("0.5,0.25,0.25").words == 0.5
    for bad in ("0.5,0.5,0.5", "1,0", "2,-1,0"):
        with pytest.raises(ValueError):
            Weights.parse(bad)


def test_porter(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
        "replacement": "replac", "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
    }
    assert {w: stem(w) for w in known} == known
    got = spark.createDataFrame([(["ponies", "cats"],), (None,), ([],)], "w array<string>").select(stemmed(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [["poni", "cat"], None, []]


def test_tokens(spark):
    df = spark.createDataFrame([("It's a well-known U.S. town; 1999, (Zürich)_x\t12a",), ("",), (None,)], "t string")
    got = [r.w for r in df.select(tokens(F.col("t")).alias("w")).collect()]
    assert got == [["its", "a", "well", "known", "u", "s", "town", "zürich", "x", "12a"], [], []]
    assert [r.w for r in df.select(without_stop_words(tokens(F.col("t"))).alias("w")).collect()][0] == ["known", "town", "zürich", "12a"]
    assert df.select(upper_first(F.lit("äbc")).alias("x")).first().x == "Äbc"


def test_names(spark):
    one = spark.range(1)
    assert one.select(irreducible(F.array(F.lit("york"), F.lit("new york"), F.lit("isle"))).alias("x")).first().x == ["york", "isle"]
    assert one.select(occurrences(F.lit(" york, (york) yorkshire york-x york "), F.lit("york")).alias("x")).first().x == 4


def test_haversine(spark):
    c = lambda *v: haversine_km(*[F.lit(x) for x in v])
    row = spark.range(1).select(c(0.0, 0.0, 0.0, 1.0).alias("a"), c(5.0, 6.0, 5.0, 6.0).alias("b"), c(0.0, 0.0, 0.0, 180.0).alias("c"), haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d")).first()
    assert abs(row.a - 111.194927) < 1e-6 and row.b == 0 and abs(row.c - math.pi * 6371) < 1e-6 and row.d is None


@pytest.fixture(scope="module")
def small(spark):
    words = spark.createDataFrame([("A", "x", 2), ("A", "y", 1), ("B", "x", 1), ("B", "y", 3), ("B", "z", 1), ("C", "x", 1), ("C", "w", 1), ("D", "q", 1)], "title string, word string, tf int")
    locs = spark.createDataFrame([("A", "P", 3, 0), ("A", "Q", 1, 5), ("B", "P", 1, 1), ("D", "Q", 1, 9)], "title string, location string, cnt int, ord int")
    cats = spark.createDataFrame([("A", "c1"), ("A", "c2"), ("B", "c1"), ("C", "c2"), ("C", "c3"), ("C", "c4")], "title string, category string")
    pos = spark.createDataFrame([("A", 1.0, 1.0), ("B", 2.0, 2.0), ("C", 3.0, 3.0)], "title string, lat double, lon double")
    return words, locs, cats, pos


def test_vectors(spark, small):
    words, locs, *_ = small
    v = vectors.word_vectors(vectors.clean_counts(words), top=2)
    norms = {r.title: r.n for r in v.groupBy("title").agg(F.sum(F.col("score") ** 2).alias("n"), F.count("*").alias("c")).collect()}
    assert all(abs(n - 1) < 1e-9 for n in norms.values()) and v.where("title = 'B'").count() == 2
    lv = {(r.title, r.location): r.score for r in vectors.location_vectors(vectors.usable_locations(locs)).collect()}
    assert abs(lv[("A", "P")] - math.sqrt(0.75)) < 1e-12 and abs(lv[("A", "Q")] - math.sqrt(0.25)) < 1e-12
    assert vectors.word_vectors(vectors.clean_counts(words.limit(0))).count() == 0


@pytest.mark.parametrize("w", [Weights(), Weights(1, 0, 0), Weights(0, 0.5, 0.5)])
def test_neighbors_against_plain(spark, small, w):
    words, locs, cats, pos = small
    wv, ul = vectors.word_vectors(vectors.clean_counts(words)), vectors.usable_locations(locs)
    lv = vectors.location_vectors(ul, top=1)
    got = {(r.title, r.neighbor): r.score for r in neighbors.nearest_neighbors(wv, lv, ul, cats, pos, w).collect()}
    tab = lambda d, k: {t: {r[k]: r["score"] for r in d.collect() if r.title == t} for t in "ABCD"}
    W, L = tab(wv, "word"), tab(lv, "location")
    U = {t: {r.location for r in ul.collect() if r.title == t} for t in "ABCD"}
    C = {t: {r.category for r in cats.collect() if r.title == t} for t in "ABCD"}
    want = {}
    for a in "ABCD":
        for b in "ABC":
            if a != b and (w.words and len(W[a].keys() & W[b].keys()) >= 2 or w.locations and U[a] & L[b].keys() or w.categories and C[a] & C[b]):
                dot = lambda x, y: sum(x[k] * y.get(k, 0) for k in x)
                union = C[a] | C[b]
                inter = len(C[a] & C[b]) if w.categories else 0
                if union:
                    s = w.words * dot(W[a], W[b]) + w.locations * dot(L[a], L[b]) + w.categories * inter / len(union)
                    if s >= 0.1:
                        want[(a, b)] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_settings_checked(spark, small):
    with pytest.raises(ValueError):
        neighbors.candidates(small[0], Settings(least_common_words=0))


def test_dense_ids(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "c", "b"]], "v string")
    assert sorted(map(tuple, neighbors.dense_ids(df, "v").collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_category_statistics(spark):
    cats = spark.createDataFrame([("a", "C"), ("b", "C"), ("c", "C"), ("u", "C"), ("s", "S"), (None, "C"), ("a", None)], "title string, category string")
    pos = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 2.0), ("c", 0.0, 4.0), ("s", 1.0, 1.0)], "title string, lat double, lon double")
    c = {r.category: r for r in category_stats.category_stats(cats, pos).collect()}["C"]
    assert (c.n_articles, c.n_located, c.lat, c.lon) == (4, 3, 0.0, 2.0)
    loo = {(r.category, r.title): r for r in category_stats.leave_one_out_means(cats, pos).collect()}
    assert loo[("C", "a")].lon == 3.0 and loo[("S", "s")].lat is None
    disp = {(r.category, r.title): r.dispersion for r in category_stats.leave_one_out_dispersions(cats, pos).collect()}
    assert abs(disp[("C", "a")] - 111.194927) < 1e-6 and ("S", "s") not in disp
    ask = spark.createDataFrame([("C", "a"), ("C", "x"), ("S", "s"), ("none", "a")], "category string, title string")
    v = {(r.category, r.title): r for r in category_stats.requester_view(ask, cats, pos).collect()}
    assert v[("C", "a")].ratio == 0.5 and v[("C", "x")].ratio == 0.6 and v[("S", "s")].n_located == 0 and v[("S", "s")].lat is None and len(v) == 3
    assert {r.title: r.n_located for r in category_stats.requester_view(ask, cats, pos, compat=True).collect()}["s"] == 1


def test_ancestors_and_augmentation(spark):
    edges = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "C")], "parent string, child string")
    starts = spark.createDataFrame([("r", "A"), ("r", "unknown"), (None, "A")], "root string, category string")
    assert sorted((r.level, r.category) for r in category_graph.ancestors(edges, starts, 4).collect()) == [(0, "A"), (1, "B"), (2, "C"), (3, "A")]
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    pages = spark.createDataFrame([("A", "new"), ("new", "newer"), ("alien", "x"), ("A", "A"), ("alien", "B")], "parent string, child string")
    got = {tuple(r) for r in category_graph.augmented_edges(edges, pages, names).select("parent", "child").collect()}
    assert got == {("B", "A"), ("C", "B"), ("A", "C"), ("A", "new"), ("new", "newer")}
    assert {tuple(r) for r in category_graph.known_edges(pages, names).select("parent", "child").collect()} == set()


def test_entity_weights(spark):
    n = spark.createDataFrame([("T", "a", 0.5, 1)], "title string, neighbor string, score double, rank int")
    e = spark.createDataFrame([("T", "a"), ("T", "b")], "title string, entity string")
    assert {r.entity: r.weight for r in weights.assign(e, weights.neighbor_weights(n)).collect()} == {"a": 0.5, "b": 0.0}
    p = spark.createDataFrame([("a", 6), ("b", 2)], "entity string, priority int")
    w = e.withColumn("weight", F.lit(1.0))
    assert {r.entity: r.weight for r in weights.boosted(w, p, e, e).collect()} == {"a": 10.0, "b": 1.0}


def test_writers(spark, tmp_path):
    base = f"file://{tmp_path}"
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert writers.materialize(spark, f"{base}/t", make).count() == 3
    assert len(made) == 1
    with pytest.raises(Exception, match="exist"):
        writers.write_new(spark.range(1), f"{base}/t")
    lines = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", [])], "n int, c string, k array<string>").select(writers.subcategory_line(F.col("n"), F.col("c"), F.col("k")).alias("l")).coalesce(1)
    writers.write_rolling_text(lines, f"{base}/s", 1)
    assert len(list((tmp_path / "s").glob("part-*"))) == 2
    assert sorted((r.category, r.subcategories) for r in readers.read_subcategories(spark, f"{base}/s").collect()) == [("A", ["x", "y"]), ("B", [])]
    v = spark.createDataFrame([([("b", 0.5), ('"q"', 0.9), ("a", 0.5)],)], "v array<struct<term string, score double>>")
    assert v.select(writers.vector_json(F.col("v")).alias("j")).first().j == '[{"term":"\\"q\\"","score":0.9},{"term":"a","score":0.5},{"term":"b","score":0.5}]'
    assert writers.neighbors_path("x", Weights(0.5, 0.25, 0.25)) == "x/neighbors_0.5000_0.2500_0.2500"


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(1, "lake lake port"), (2, "lake")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    q = corpus.stream_documents(spark, f"file://{tmp_path}/in", "doc_id long, text string").writeStream.foreachBatch(lambda d, k: corpus.append_term_counts(d, k, f"file://{tmp_path}/out"))
    q = q.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.word: (r.tf, r.df) for r in corpus.term_totals(spark, f"file://{tmp_path}/out", list(range(5))).collect()}
    assert got == {"lake": (3, 2), "port": (1, 1)}
    ev = spark.sql("select timestamp'2020-01-01 00:10:00' ts, 'a' k union all select timestamp'2020-01-01 00:50:00', 'a'")
    assert corpus.windowed_counts(ev, "ts", "k").first().n == 2


def test_entry(spark, sf):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert entry.entry(spark).columns == ["title", "neighbor", "score", "rank"]


@pytest.mark.parametrize("name", ["p4_found", "p7_found", "tfidf_top20", "knn_blended", "tokenise_no_stem", "stats_of_categories", "graph_edges", "type_cascade"])
def test_queries_against_sql(spark, sf, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_salted_join_and_segments(spark):
    from atlaswright.operators.skew import salted_join

    left = spark.createDataFrame([("hot", k) for k in range(50)] + [("b", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("hot", "p"), ("hot", "q"), ("b", "r"), ("c", "s"), (None, "t")], "k string, y string")
    got = sorted(map(tuple, salted_join(left, right, ["k"], "x", 7).collect()))
    assert got == sorted(map(tuple, left.join(right, "k").collect())) and len(got) == 101
    rows = left.where("k is not null").select(F.lit("f").alias("feature"), F.col("k").alias("term"), F.col("x").cast("string").alias("title"), F.lit(0.5).alias("score"))
    lists = neighbors.posting_lists(rows, 8).collect()
    assert sum(len(r.list) for r in lists) == 51 and max(len(r.list) for r in lists) < 30


@pytest.mark.parametrize("block", [512, 7])
def test_similar_titles_of_a_frequent_term(spark, block):
    """A term that nearly all titles have; pairs against brute force, whatever the blocks."""
    import math
    import random

    r = random.Random(block)
    raw = {f"t{k:02}": {f"w{r.randint(0, 25)}": r.random() + 0.01 for _ in range(r.randint(1, 6))} | ({"all": r.random()} if k % 9 else {}) for k in range(60)}
    unit = {t: {w: x / math.sqrt(sum(y * y for y in ws.values())) for w, x in ws.items()} for t, ws in raw.items()}
    rows = [("words", w, t, x, t < "t45", False) for t, ws in unit.items() for w, x in ws.items()]
    df = spark.createDataFrame(rows, "feature string, term string, title string, score double, indexed boolean, extra boolean")
    ids, (own,) = neighbors._numbered(df)
    pairs = neighbors.blocked_pairs(own, {"words": 1.0, "locations": 0.0, "categories": 0.0}, 0.5, dict.fromkeys(neighbors.FEATURES, 1), False, block)
    got = {(x.title, x.neighbor): x.score for x in neighbors._named(pairs, ids).collect()}
    dot = lambda a, b: sum(x * unit[b].get(w, 0.0) for w, x in unit[a].items())
    want = {(a, b): dot(a, b) for a in unit for b in unit if a != b and b < "t45" and dot(a, b) >= 0.5 - 1e-7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 100
