"""A hand-made dump through readers, page parsing and the whole build."""

import json

import pytest
from pyspark.sql import functions as F

from atlaswright import session
from atlaswright.config import Weights
from atlaswright.functions import wikitext as W
from atlaswright.functions.coordinate_templates import template_position
from atlaswright.functions.text import elapsed, short_number
from atlaswright.operators.article_types import article_types
from atlaswright.operators.articles import build_features
from atlaswright.operators.entities import named_locations
from atlaswright.operators.signals import is_a_in, located_at
from atlaswright.sources import readers as R
from atlaswright.sources.writers import value_json, write_neighbors


def page(title, body, head=""):
    return f'  <page>\n    <title>{title}</title>\n{head}\n    <text xml:space="preserve">{body}</text>\n\n  </page>\n'


HALL = """{{coord|38|53|14.31|N|77|1|19.98|W|type:landmark|display=inline,title}}
'''Old Hall''' is a museum located in [[Norville]], a town of the [[North Isle|isle]]. Near [[Norville]] is the quay.
Norville has a port. [[File:x.png|thumb]] [[Category:Museums in Norville#x]] [[category : Halls|k]]
* a list line
== History ==
The {{cite|a {{b}}}} museum &lt;ref&gt;x&lt;/ref&gt; opened. See new [[Oldtown]] and Oldtown."""

DUMP = (
    "<mediawiki>\n<siteinfo>none</siteinfo>\n"
    + page("Old Hall", HALL)
    + page("Norville", "{{Coord|44.532447|N|10.864137|E|display=it}}\n'''Norville''' is a town in [[North Isle]].\n[[Category:Towns in North Isle]]")
    + page("North Isle", "{{Coord|display=title|34.0999|-117.6470}}\n'''North Isle''' is an island.")
    + page("Oldtown", "{{coord|1|N|2|E|display=title|globe:moon}} '''Oldtown''' was a city.")
    + page("Norvil", "#REDIRECT", '    <redirect title="Norville" />')
    + page("List of things", "a") + page("X (disambiguation)", "b") + page("File:Y.png", "c") + page("Category:Halls", "[[Category:Buildings]]")
    + page("A &quot;b&quot; &amp; c", "plain text")
    + "</mediawiki>\n"
)


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("dump") / "dump.xml"
    p.write_text(DUMP, encoding="utf-8")
    return R.read_pages(spark, f"file://{p}").cache()


def test_titles_and_filters(pages):
    assert pages.count() == 10
    got = {r.title for r in R.articles_only(pages).collect()}
    assert got == {"Old_Hall", "Norville", "North_Isle", "Oldtown", 'A_"b"_&_c'}
    assert "Category:Halls" in {r.title for r in R.articles_only(pages, True).collect()}
    assert R.read_pages.__doc__
    assert [tuple(r) for r in R.redirects(pages).collect()] == [("Norvil", "Norville", "Norville")]


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "lat", "lon"),
    [
        ("{{coord|38|53|14.31|N|77|1|19.98|W|type:landmark|display=inline,title}}", 38.887308, -77.022217),
        ("{{Coord|44.532447|N|10.864137|E|display=it}}", 44.532447, 10.864137),
        ("{{Coord|display=title|34.0999|-117.6470}}", 34.0999, -117.6470),
        ("{{Coord|12|S|3|E|display=title}} {{Coord|13|S|4|W|display=title}}", -13, -4),
        ("{{Coord|12|N|3|E|display=title|globe:moon}}", None, None),
        ("&lt;!-- {{Coord|12|N|3|E|display=title}} --&gt;", None, None),
        ("{{Coord|12|N|3|E}}", None, None),
        ("{{Coord|10|20}} inline\nand\n{{Coord|30|40|display=title}}", 30, 40),
        ("{{Coord|38&lt;!--42--&gt;|53|14.31|N|77|1|19.98|W|display=title}}", 38.887308, -77.022217),
        ("&lt;!--{{Coord|12|N|3|E|display=title}}--&gt; {{Coord|13|N|4|E|display=title}}", 13, 4),
        ("{{Coord|12|N|3|E\n|display=title}}", None, None),
        ("", None, None),
    ],
)
def test_template_positions(spark, text, lat, lon):
    p = one(spark, template_position(F.col("t")), t=text)
    assert (p is None and lat is None) or (round(p.lat, 6), round(p.lon, 6)) == (lat, lon)
    assert one(spark, template_position(F.col("t")), t=None) is None


def test_clean_text(spark):
    t = "[[File:x.png|thumb]] [[Foo bar|label]] {{cite}} == H ==\n* item\n[[a [[b|c]] d]] {| t |} x &amp; y"
    got = one(spark, W.clean_text(F.col("t"), F.col("n")), t=t, n="None_such")
    assert got.split() == ["Foo", "bar", "a", "b", "d", "x", "y"]
    assert one(spark, W.clean_text(F.col("t"), F.col("n")), t="", n="a") == ""
    assert one(spark, W.clean_text(F.col("t"), F.col("n")), t=None, n="a") is None
    assert one(spark, W.clean_text(F.col("t"), F.col("n")), t="intro '''Foo bar''' x", n="Foo-bar,_Q") == "'''Foo bar''' x"
    assert one(spark, W.clean_text(F.col("t"), F.col("n")), t="[[a|sculpture sculptor]] [[b|musical theatre]]", n=None) == "sculptor musical"


def test_categories_and_links(spark):
    cats = one(spark, W.page_categories(F.col("t")), t="[[Category:Cities in X#y]] [[category : Z|k]]")
    assert cats == ["Cities_in_X", "Z"]
    assert one(spark, W.links(F.col("t")), t="[[A b|c]] [[File:x]] [[ D ]]") == [["A b", "c"], ["D"]]
    assert one(spark, W.first_word_index(F.col("t"), F.col("n")), t="in new york and york", n="york") == 4
    assert one(spark, W.first_word_index(F.col("t"), F.col("n")), t="none", n="york") == -1


def test_build(spark, pages):
    f = build_features(pages)
    a = {r.title: r for r in f["articles"].collect()}
    hall = a["Old_Hall"]
    assert (hall.type, hall.located_at, hall.is_a_in) == ("SPOT", "Norville", ["Norville", "North_Isle"])
    assert [(n.location, n.cnt) for n in hall.named_locations] == [("Norville", 3), ("North_Isle", 1)]
    assert a["Norville"].type == "SETTLEMENT" and a["North_Isle"].type == "LAND" and a["Oldtown"].coords is None
    assert abs(sum(w.score**2 for w in hall.words) - 1) < 1e-9


def test_located_at_cancelled(spark):
    pages = lambda raw: spark.createDataFrame([("T", raw, raw.replace("[[", "").replace("]]", ""))], "title string, raw string, clean string")
    pos = spark.createDataFrame([("Paris", 48.0, 2.0)], "title string, lat double, lon double")
    hops = spark.createDataFrame([("Lutetia", "Paris", "Paris")], "title string, target_raw string, target string")
    types = spark.createDataFrame([("Paris", 5)], "title string, priority int")
    at = lambda raw: [r.location for r in located_at(pages(raw), hops, pos, types).collect()]
    assert at("It is located in [[Paris, Texas]].") == []
    assert at("It is located in [[Paris]].") == ["Paris"]
    assert at("It is located in [[Lutetia]].") == ["Paris"]
    assert at("It is located in [[Paris]], 20 km north.") == []
    assert at("It was. Found in [[Paris]].") == []
    assert at("It is located in [[Paris, Texas]]" + " a" * 80 + " [[Paris]].") == []
    assert at("It is located in [[paris]].") == ["Paris"] and at("It is located near [[PARIS|the town]].") == []
    assert at("It is located in [[Paris]], 20 KM north.") == at("It is located in [[Paris]] {{Convert|20|km}} north.") == []
    assert at("It is located in new [[Paris]].") == [] and at("It is\n \nlocated in a\n \n[[Paris]].") == []
    assert at("It is headquartered in [[Rome]] and located in [[Paris]].") == ["Paris"]


def test_scattered_entities_and_their_redirects(spark):
    raw = "It is located in [[Paris]] and [[Byron]]."
    pages = spark.createDataFrame([("T", raw, raw.replace("[[", "").replace("]]", ""))], "title string, raw string, clean string")
    pos = spark.createDataFrame([("Paris", 48.0, 2.0), ("Byron_Bay", -28.6, 153.6)], "title string, lat double, lon double")
    hops = spark.createDataFrame([("Byron", "Byron Bay", "Byron_Bay")], "title string, target_raw string, target string")
    fine = lambda p: spark.createDataFrame([("Paris", 5), ("Byron_Bay", p)], "title string, priority int")
    assert located_at(pages, hops, pos, fine(5)).count() == 0
    assert [r.location for r in located_at(pages, hops, pos, fine(2)).collect()] == ["Paris"]


def test_types(spark):
    rows = [
        ("A", "", "", ["1990_mountains_of_X"]), ("B", "", "", ["1950_births"]), ("C", "| settlement_type = [[List of towns|State capital]]\n", "", []),
        ("D", "", "It is the united states of some country club in x", []), ("E", "", "X is an island country near", ["Countries_in_Y"]), ("F", "", "X is an island country near", []),
        ("Q_(ship)", "", "", None), ("The_fellowship)", "", "", []), ("G", "", None, []), ("H", "", "He is in a town", []),
    ]
    df = spark.createDataFrame(rows, "title string, raw string, clean string, categories array<string>")
    got = {r.title: r.type for r in article_types(df).collect()}
    assert got == {"A": "NATURE", "B": "PERSON", "C": "SETTLEMENT", "D": "NONE", "E": "COUNTRY", "F": "LAND", "Q_(ship)": "SHIP", "The_fellowship)": "NONE", "G": "NONE", "H": "NONE"}


def test_redirected_entity_counts_once(spark):
    texts = spark.createDataFrame([("T", "[[Lutetia]] and [[Paris|the city]]", "Lutetia and Paris, the city; Paris")], "title string, text string, clean string")
    hops = spark.createDataFrame([("Lutetia", "Paris", "Paris")], "title string, target_raw string, target string")
    pos = spark.createDataFrame([("Paris", 48.0, 2.0)], "title string, lat double, lon double")
    assert [(r.location, r.cnt, r.ord) for r in named_locations(texts, hops, pos).collect()] == [("Paris", 3, 1)]


def test_is_a_in_needs_period(spark):
    pos = spark.createDataFrame([("T", 1.0, 1.0), ("Paris", 48.0, 2.0)], "title string, lat double, lon double")
    hops = spark.createDataFrame([], "title string, target_raw string, target string")
    go = lambda raw: [(r.location, r.pos) for r in is_a_in(spark.createDataFrame([("T", raw)], "title string, raw string"), hops, pos).collect()]
    assert go("'''T''' is a town in [[Paris]].") == [("Paris", 0)]
    assert go("'''T''' is a town in [[Paris]]") == []
    assert go("'''T''' is a town in [[Paris]], 12 km away.") == []
    assert go("'''T''' . is a town in [[Paris]].") == [("Paris", 0)] and go("'''T''' old. is a town in [[Paris]].") == []


def test_replies_and_files(spark, tmp_path):
    reply = json.dumps({"query": {"categorymembers": [{"pageid": 1, "ns": 14, "title": "Category:Fields of history"}]}, "continue": {"cmcontinue": "page|x"}})
    assert one(spark, R.member_names(F.col("t")), t=reply) == ["Fields_of_history"]
    assert one(spark, R.continuation(F.col("t")), t=reply) == "page|x"
    own = json.dumps({"query": {"categorymembers": [{"title": "Category:A b"}, {"title": "Category:C"}, {"title": "Category:A b"}]}})
    assert one(spark, R.member_names(F.col("t"), F.col("c")), t=own, c="A b") == ["C", "A_b"] and one(spark, R.member_names(F.col("t"), F.col("c")), t=own, c="C") == ["A_b", "C", "A_b"]
    assert one(spark, R.member_names(F.col("t"), F.col("c")), t="{}", c="C") == [] and one(spark, R.member_names(F.col("t")), t='{"query":') is None
    got, more, bad = R.member_links(spark.createDataFrame([("A", reply), ("B", "{"), ("C", None)], "category string, reply string"))
    assert [tuple(r) for r in got.collect()] == [("A", ["Fields_of_history"])] and more.first()["cmcontinue"] == "page|x" and bad.first()["rejected"] == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "Fields+of%2Fx.json").write_text(reply)
    (tmp_path / "r" / "Fields+of%2Fx~page%7Cx.json").write_text(own)
    links, more, bad = R.member_links(R.read_replies(spark, f"file://{tmp_path}/r"))
    assert sorted(tuple(r) for r in links.collect()) == [("Fields of/x", ["A_b", "C", "A_b"]), ("Fields of/x", ["Fields_of_history"])] and bad.first()["rejected"] == 0
    assert one(spark, R.views_url(F.col("t"), "x/%s/y"), t="Ä b&c") == "x/%C3%84+b%26c/y"
    assert one(spark, R.view_counts(F.col("t")), t='{"items":[{"views":3.0},{"views":null}]}') == [3, None]
    (tmp_path / "c.sql").write_text("INSERT INTO `category` VALUES (1,'A,_b',2),(2,'It\\'s',3),(3,'A,_b',4);\nother\n")
    assert {r.name for r in R.read_category_names(spark, f"file://{tmp_path}/c.sql").collect()} == {"A,_b", "It's"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("1\tA b\t[x y|||Category:Z]\n2\tC\t[]\n")
    got = [(r.counter, r.category, r.subcategories) for r in R.read_subcategories(spark, f"file://{tmp_path}/t").orderBy("counter").collect()]
    assert got == [(1, "A b", ["x y", "Category:Z"]), (2, "C", [])]


def test_json_of_any_value(spark):
    row = [("a", [1.5, None], {"k\"": True}, {"n": "x", "v": ["y", "z"]}, 7), (None, None, None, None, None)]
    df = spark.createDataFrame(row, 's string, l array<double>, m map<string, boolean>, p struct<n: string, v: array<string>>, i int')
    texts = df.select(*[value_json(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).collect()
    assert [json.loads(t) for t in texts[0]] == ["a", [1.5, None], {'k"': True}, {"x": ["y", "z"]}, 7] and set(texts[1]) == {"null"}


def test_neighbor_sink(spark, tmp_path):
    near = spark.createDataFrame([("A", "C", 0.5, 2), ("A", "B", 0.9, 1)], "title string, neighbor string, score double, rank int")
    titles = spark.createDataFrame([("A",), ("B",)], "title string")
    ids = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "title string, id bigint")
    path = write_neighbors(near, titles, ids, f"file://{tmp_path}", Weights())
    assert {r.id: [(n.id, round(n.score, 3)) for n in r.neighbors] for r in spark.read.parquet(path).collect()} == {0: [(1, 0.9), (2, 0.5)], 1: []}
    with pytest.raises(Exception, match="exist"):
        write_neighbors(near, titles, ids, f"file://{tmp_path}", Weights())


def test_numbers_and_times(spark):
    rows = spark.createDataFrame([(1.0,), (0.126,), (2.5,), (None,)], "x double")
    assert [r.y for r in rows.select(short_number(F.col("x")).alias("y")).collect()] == ["1", "0.13", "2.5", None]
    assert rows.limit(1).select(elapsed(F.lit(3725)).alias("y")).first()["y"] == "1:02:05"


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):  # noqa: ANN002, ANN201
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: ANN201, N802
            return Conf()

        def getCheckpointDir(self):  # noqa: ANN201, N802
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="share"):
        session.scratch_dir(Session())


def test_cut_tables_go_when_nothing_reads_them(spark):
    import gc
    import os
    import time

    table, path = session.cut(spark.range(5), "gone")
    other = table.where("id > 2")
    del table
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    session.cut(spark.range(1), "next")
    assert other.count() == 2 and os.path.exists(path.removeprefix("file://"))
    del other
    for _ in range(60):
        gc.collect()
        spark.range(3).collect()
        spark.sparkContext._jvm.System.gc()
        session.cut(spark.range(1), "next")
        if not os.path.exists(path.removeprefix("file://")):
            return
    pytest.fail("the table is still there")
