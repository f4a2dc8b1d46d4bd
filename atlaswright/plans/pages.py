"""Queries of page extraction over written pages, and SQL that reads the same pages by means of its own.

The test tables hold hardly any markup. So each title with usable named locations gets a page after one of sixteen patterns, which name its first
locations; the patterns bring up the cases that parsing has to tell apart. The SQL makes the same pages and parses them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.functions.coordinate_templates import INNER, OUTER, template_position
from atlaswright.functions.text import AFTER, BEFORE, STOP_WORDS
from atlaswright.functions.wikitext import clean_text, page_categories, page_text
from atlaswright.operators import entities, signals, vectors
from atlaswright.operators.article_types import PERSON_CATEGORIES, PRIORITY, STOP_AT, TYPES, VARIANTS, VERBS, article_type
from atlaswright.operators.proximity import current_positions
from atlaswright.plans.core_queries import _POSITIONS, _reading, table
from atlaswright.session import cut, scratch_dir
from atlaswright.sources import readers, writers

PATTERNS = [
    "{{coord|38|53|14.31|N|77|1|19.98|W|type:landmark|display=inline,title}}\n'''{T}''' is a museum located in [[{A}]], a town of [[{B}|the land]]. Near [[{A}]] is a quay.\n{A} has a port. [[File:x.png|thumb]]\n* a list line\n== History ==\nThe {{cite|a {{b}}}} museum &lt;ref&gt;x&lt;/ref&gt; opened. See new [[{C}]] and {C}.\n[[Category:Museums in {A}#x]] [[category : Halls|k]]",
    "{{Coord|10|20}} inline\nand more\n{{Coord|30.5|40.25|display=title}}\n'''{T}''' lies located near [[{a}|the place]] and [[{B}]]. The end.\n[[Category:Rivers of {B}]]",
    "{{Coord|38&lt;!--42--&gt;|53|14.31|N|77|1|19.98|W|display=title}}\n'''{T}''' is located in [[{A}, {B}]] near [[{A}]]. It was a village in [[{B}]].",
    "{{Coord|12|S|3|E|display=it}} {{Coord|13|S|4|W|display=title}}\n'''{T}''' is a village in [[{A}]], located in [[{A}]], 20 KM from [[{B}]].",
    "{{Coord|display=title|34.0999|-117.6470}}\n'''{T}''' was located in [[{A}]] {{Convert|20|km}} away from [[{B}]]. x",
    "'''{T}''' is a hill located at [[Old {A}]] and [[{B}]]. It is found in [[{C}]].",
    "'''{T}''' is a town located in new [[{A}]] or [[{B}]]. y",
    "'''{T}''' was headquartered in [[Nowhere {T}]] and located in [[{A}]] on a lake. z",
    "'''{T}''' stands. It is located in [[{A}]]. &lt;!-- {{Coord|12|N|3|E|display=title}} --&gt;",
    "'''{T}''' are hills located in [[{A}]], [[{B}]] and [[Old {C}]] in the east.",
    "'''{T}''' located in the middle\n \n[[{A}]] of things. {{Coord|12|N|3|E|display=title|globe:moon}}",
    "'''{T}''' " + "far " * 31 + "located in [[{A}]].",
    "| settlement_type = [[List of towns|State capital]]\n'''{T}''' located east of [[{B}]]\nor [[{A}|{B}]]. The {A}, \"{A}\" and ({A}).",
    "{| table {x} |}\n'''{T}''' is an island country near the sea of [[{C}]]. In [[{A}|{a}]] [[{B}|q]]. [[:Category:X]] [[{T}]]\n[[Category:Countries in {B}]]",
    "'''{T}''' (old) were rivers at [[{A}]], . &quot;[[Old {B}|x]]&quot; ended.",
    "'''{T}''' is in [[{B}]] [[a [[b|c]] d]] [[x|sculpture sculptor]] [[y|musical theatre]] and [[{A}]]. End is [[{C}]].",
]
FRAME = '\n<title>{T}</title>\n<text xml:space="preserve">{X}</text>\n'

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- the pages -------------------------------------------------------------------------------------------


def _raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``title, raw``: a page for each title with usable named locations."""
    locs = vectors.usable_locations(table(spark, sf, "named_locations")).groupBy("title").agg(F.array_sort(F.collect_list(F.struct("ord", "location"))).alias("l"))
    name = lambda k: F.replace(F.get("l", F.lit(k))["location"], F.lit("_"), F.lit(" "))
    s = locs.select("title", F.replace("title", F.lit("_"), F.lit(" ")).alias("T"), name(0).alias("A"), F.coalesce(name(1), name(0)).alias("B"), F.coalesce(name(2), name(1), name(0)).alias("C"))
    body = F.element_at(F.array(*map(F.lit, PATTERNS)), ((F.length("title") * 7 + F.length("A") * 3 + F.length("B")) % len(PATTERNS) + 1).cast("int"))
    raw = F.replace(F.lit(FRAME), F.lit("{X}"), body)
    for mark, value in (("{T}", F.col("T")), ("{A}", F.col("A")), ("{B}", F.col("B")), ("{C}", F.col("C")), ("{a}", F.concat(F.lower(F.substring("A", 1, 1)), F.expr("substring(A, 2)")))):
        raw = F.replace(raw, F.lit(mark), value)
    return s.select("title", raw.alias("raw"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """``title, raw, text, clean, categories``, parsed."""
    p = _raw_pages(spark, sf).withColumn("text", page_text(F.col("raw")))
    p = p.withColumn("clean", clean_text(F.col("text"), F.col("title"))).withColumn("categories", page_categories(F.col("raw")))
    return cut(p, "pages")[0]  # clean text is read many times


def _hops(spark: SparkSession, sf: str) -> DataFrame:
    """Redirects: ``Old_X`` for each named location X."""
    x = vectors.usable_locations(table(spark, sf, "named_locations")).select("location").distinct()
    return x.select(F.concat(F.lit("Old_"), "location").alias("title"), F.replace("location", F.lit("_"), F.lit(" ")).alias("target_raw"), F.col("location").alias("target"))


def _spots(spark: SparkSession, sf: str) -> DataFrame:
    return current_positions(table(spark, sf, "coordinates"))


def _priorities(spark: SparkSession, sf: str) -> DataFrame:
    return _spots(spark, sf).select("title", (F.length("title") % 7).alias("priority"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PAGES = f"""{_POSITIONS},
locs AS (
  SELECT title, location, min(ord) AS ord FROM (
    SELECT title, nullif(regexp_replace(regexp_replace(location, '^[\\s_]+|[\\s_]+$', '', 'g'), '\\s', '_', 'g'), '') AS location, ord FROM named_locations
    WHERE title IS NOT NULL AND cnt >= 1 AND ord BETWEEN 0 AND 250)
  WHERE location IS NOT NULL GROUP BY title, location),
l AS (SELECT title, list(replace(location, '_', ' ') ORDER BY ord, location) AS l FROM locs GROUP BY title),
s AS (SELECT title, replace(title, '_', ' ') AS t, l[1] AS a, coalesce(l[2], l[1]) AS b, coalesce(l[3], l[2], l[1]) AS c FROM l),
raw AS (SELECT title, replace(replace(replace(replace(replace(replace({_lit(FRAME)}, '{{X}}', [{", ".join(map(_lit, PATTERNS))}][(length(title) * 7 + length(a) * 3 + length(b)) % {len(PATTERNS)} + 1]),
    '{{T}}', t), '{{A}}', a), '{{B}}', b), '{{C}}', c), '{{a}}', lower(a[1]) || a[2:]) AS raw FROM s),
hops AS (SELECT DISTINCT 'Old_' || location AS title, location AS target FROM locs)
"""

_INNER = r"(?:[^\[\]]|\][^\[\]])*?"
_LINKS = [
    (rf"\[\[{_INNER}File:{_INNER}\]\]", ""),
    (rf"\[\[{_INNER}\|{_INNER}(?i:sculpture){_INNER}(?i:sculptor){_INNER}\]\]", "sculptor"),
    (rf"\[\[{_INNER}\|{_INNER}(?i:musical theatre){_INNER}\]\]", "musical"),
    (rf"\[\[((?:[^\[\]|]|\][^\[\]|])*)(?:\|{_INNER})?\]\]", r"\1"),
]
_SCRUB = [*_LINKS * 3, *[(r"\{\{[^{]*?\}\}", "")] * 3, *[(r"\{[^{]*?\}", "")] * 3, ("&lt;.*?&gt;", " ")]


def _clean_sql(source: str, text: str) -> str:
    """CTEs ending in ``clean`` (all columns of the source and ``clean``) for a source with ``title`` and a text column."""
    e = text
    for pattern, put in _SCRUB:
        e = f"regexp_replace({e}, {_lit(pattern)}, {_lit(put)}, 'gs')"
    e = f"regexp_replace(regexp_replace({e}, '={{1,3}}.*=', ' ', 'g'), '(&quot;)|(&amp;)|(nbsp;)|(wikt:)', ' ', 'g')"
    lines = f"array_to_string(list_filter(string_split({e}, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(Category:|\\||!|\\*|#|Image:)')), chr(10))"
    return f"""bare AS (SELECT *, {lines} AS u, trim(replace(regexp_replace(title, '[,(].*$', ''), '_', ' ')) AS plain FROM {source}),
seen AS (SELECT *, strpos(u, '''''''' || plain) AS p, strpos(u, '''''''' || trim(replace(plain, '-', ' '))) AS q FROM bare),
clean AS (SELECT * EXCLUDE (u, plain, p, q), CASE WHEN (CASE WHEN p > 0 THEN p ELSE q END) BETWEEN 1 AND 250 THEN substr(u, CAST(CASE WHEN p > 0 THEN p ELSE q END AS BIGINT)) ELSE u END AS clean FROM seen)"""


_TEXT = "text AS (SELECT *, regexp_extract(raw, '<text xml.*?>(.*?)</text>', 1, 's') AS text FROM raw)"
_PARSED = f"{_PAGES}, {_TEXT}, {_clean_sql('text', 'text')}"


# -- readers ---------------------------------------------------------------------------------------------


def _written(df: DataFrame) -> str:
    path = f"{scratch_dir(df.sparkSession)}/fixture-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def _dump(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of all pages, of redirects and of pages that are no articles, written and read back."""
    pages = _raw_pages(spark, sf).select(F.concat(F.lit("<page>"), "raw", F.lit("\n  \n</page>")).alias("value"))
    hop = F.concat(F.lit("<page>\n<title>"), F.replace("title", F.lit("_"), F.lit(" ")), F.lit('</title>\n<redirect title="'), "target_raw", F.lit('" />\n</page>'))
    odd = spark.createDataFrame([(f"<page>\n<title>{t}</title>\n<text xml:x>[[a]]</text>\n</page>",) for t in ODD], "value string")
    head = spark.createDataFrame([("<mediawiki>\n<siteinfo>none</siteinfo>",)], "value string")
    return readers.read_pages(spark, _written(head.unionByName(pages).unionByName(_hops(spark, sf).select(hop.alias("value"))).unionByName(odd)))


ODD = ["List of things", "X (disambiguation)", "File:Y.png", "Category:Halls", "A &quot;b&quot; &amp; c", "Portal:Sea", "Wikipedia:About", "Template:Box"]


@_query(f"WITH {_PAGES} SELECT title, length(regexp_extract(regexp_replace(raw, '\\n(\\s*\\n)+', chr(10), 'g'), '<text xml.*?>(.*?)</text>', 1, 's')) AS chars FROM raw UNION ALL SELECT 'A_\"b\"_&_c', 5")
def dump_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and text lengths of the articles of a written dump."""
    return readers.articles_only(_dump(spark, sf)).select("title", F.length(page_text(F.col("raw"))).cast("long").alias("chars"))


@_query(f"WITH {_PAGES} SELECT title, replace(target, '_', ' ') AS target_raw, target FROM hops")
def dump_redirects(spark: SparkSession, sf: str) -> DataFrame:
    return readers.redirects(_dump(spark, sf))


_FROM_SQL = f"SELECT DISTINCT {_reading('category')} AS name FROM categories"


@_query(f"SELECT name FROM ({_FROM_SQL}) WHERE name IS NOT NULL UNION SELECT {_reading('category')} FROM subcategories WHERE {_reading('category')} IS NOT NULL")
def all_category_names(spark: SparkSession, sf: str) -> DataFrame:
    """Category names of a written SQL dump and of a table of pages."""
    c = table(spark, sf, "categories").where("category is not null").select("category")
    quoted = F.regexp_replace(F.regexp_replace("category", r"\\", r"\\\\"), "'", r"\\'")
    rows = c.select(F.concat(F.lit("("), F.monotonically_increasing_id().cast("string"), F.lit(",'"), quoted, F.lit("',3,0)")).alias("v"))
    lines = rows.groupBy(F.pmod(F.xxhash64("v"), F.lit(50))).agg(F.collect_list("v").alias("vs")).select(F.concat(F.lit("INSERT INTO `category` VALUES "), F.array_join("vs", ","), F.lit(";")).alias("value"))
    named = readers.read_category_names(spark, _written(lines))
    return readers.all_category_names(named, table(spark, sf, "subcategories").select("category"))


@_query(f"SELECT DISTINCT counter, trim(regexp_replace(category, '[\\n\\t]', ' ', 'g')) AS category, coalesce(len(list_filter(subcategories, lambda k: length(k) > 0)), 0) AS n, coalesce(array_to_string(list_filter(subcategories, lambda k: length(k) > 0), '|||'), '') AS kids FROM subcategories WHERE length(trim(category)) > 0")
def subcategory_files(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of the category service written as text lines, at most 2,500 a file, and read back."""
    s = table(spark, sf, "subcategories").where(F.length(F.trim("category")) > 0)
    path = f"{scratch_dir(spark)}/fixture-{uuid.uuid4().hex}"
    kids = F.filter(F.coalesce("subcategories", F.array().cast("array<string>")), lambda k: F.length(k) > 0)
    writers.write_rolling_text(s.select(writers.subcategory_line(F.col("counter"), F.trim("category"), kids).alias("value")), path)
    back = readers.read_subcategories(spark, path)
    return back.select("counter", "category", F.size("subcategories").cast("long").alias("n"), F.array_join("subcategories", "|||").alias("kids"))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """The service's replies as JSON: a category itself first in every third one, a token in every fourth, every fifth cut off."""
    s = table(spark, sf, "subcategories").where("category is not null")
    kids = F.filter(F.coalesce("subcategories", F.array().cast("array<string>")), lambda k: k.isNotNull())
    kids = F.when(F.col("counter") % 3 == 0, F.concat(F.array("category"), kids)).otherwise(kids)
    members = F.struct(F.struct(F.transform(kids, lambda k: F.struct(F.lit(1).alias("pageid"), F.lit(14).alias("ns"), F.concat(F.lit("Category:"), k).alias("title"))).alias("categorymembers")).alias("query"),
                       F.when(F.col("counter") % 4 == 0, F.struct(F.concat(F.lit("page|"), F.col("counter").cast("string")).alias("cmcontinue"))).alias("continue"))
    whole = s.select("counter", "category", F.to_json(members).alias("reply"))
    return whole.withColumn("reply", F.when(F.col("counter") % 5 == 0, F.expr("substring(reply, 1, length(reply) - 3)")).otherwise(F.col("reply")))


_KIDS = f"list_transform(CASE WHEN counter % 3 = 0 THEN list_prepend(category, ks) ELSE ks END, lambda k: {_reading("('Category:' || k)")})"
_MEMBERS = f"""m AS (SELECT counter, {_reading('category')} AS own, {_KIDS} AS ks
  FROM (SELECT counter, category, list_filter(coalesce(subcategories, []), lambda k: k IS NOT NULL) AS ks FROM subcategories WHERE category IS NOT NULL AND counter % 5 <> 0))"""


@_query(f"WITH {_MEMBERS} SELECT counter, array_to_string(list_transform(CASE WHEN ks[1] = own THEN ks[2:] ELSE ks END, lambda k: coalesce(k, '-')), '|') AS names, CASE WHEN counter % 4 = 0 THEN 'page|' || counter END AS token FROM m")
def member_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Names and continuation tokens of category replies; malformed ones go."""
    r = _replies(spark, sf)
    names = readers.member_names(F.col("reply"), F.col("category"))
    return r.select("counter", F.array_join(names, "|", "-").alias("names"), readers.continuation(F.col("reply")).alias("token")).where("names is not null")


@_query("SELECT count(*) FILTER (counter % 5 = 0) AS rejected FROM subcategories WHERE category IS NOT NULL")
def rejected_replies(spark: SparkSession, sf: str) -> DataFrame:
    """How many replies were malformed."""
    return readers.member_links(_replies(spark, sf).select("category", "reply"))[2]


@_query("SELECT title, fetched_at, array_to_string(list_transform(items, lambda i: coalesce(CAST(CAST(trunc(CASE WHEN isnan(i.views) THEN NULL ELSE i.views END) AS BIGINT) AS VARCHAR), '-')), ',') AS views FROM article_views WHERE items IS NOT NULL")
def view_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Views of the items of JSON replies, as integers."""
    v = table(spark, sf, "article_views").where("items is not null")
    plain = F.transform("items", lambda i: F.struct(i["stamp"].cast("string").alias("timestamp"), F.nanvl(i["views"], F.lit(None).cast("double")).alias("views")))
    reply = F.to_json(F.struct(plain.alias("items")), {"ignoreNullFields": "false"})
    counts = readers.view_counts(reply)
    return v.select("title", "fetched_at", F.array_join(F.transform(counts, lambda n: n.cast("string")), ",", "-").alias("views"))


@_query("SELECT DISTINCT title, 'https://views.example/' || replace(replace(url_encode(title), '%20', '+'), '~', '%7E') || '/monthly' AS url FROM documents WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM article_views WHERE title IS NOT NULL)")
def view_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of the views of titles without a reply."""
    t = readers.titles_without_views(table(spark, sf, "documents"), table(spark, sf, "article_views"))
    return t.select("title", readers.views_url(F.col("title"), "https://views.example/%s/monthly").alias("url"))


# -- text and categories ---------------------------------------------------------------------------------


@_query(f"WITH {_PARSED} SELECT title, clean FROM clean")
def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of the pages."""
    return _pages(spark, sf).select("title", "clean")


@_query(f"WITH docs AS (SELECT doc_id, coalesce(title, '') AS title, title IS NULL AS untitled, text FROM documents), {_clean_sql('docs', 'text')} SELECT doc_id, CASE WHEN untitled THEN clean ELSE clean END AS clean FROM clean")
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of the documents."""
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text"), F.col("title")).alias("clean"))


@_query(f"WITH {_PAGES} SELECT title, unnest(list_transform(regexp_extract_all(raw, '\\[\\[[Cc]ategory *: *(.*?)(\\||\\]\\])', 1), lambda c: replace(trim(regexp_replace(c, '#.*$', '', 's')), ' ', '_'))) AS category FROM raw")
def page_category_links(spark: SparkSession, sf: str) -> DataFrame:
    """Categories as found on the pages."""
    return _raw_pages(spark, sf).select("title", F.explode(page_categories(F.col("raw"))).alias("category"))


# -- positions in templates ------------------------------------------------------------------------------

_RE2 = OUTER.replace("}}", "\\}\\}")
_DEGREES = "CAST(ps[{a}] AS DOUBLE) + CASE WHEN {n} > 1 THEN CAST(ps[{a} + 1] AS DOUBLE) / 60 ELSE 0 END + CASE WHEN {n} > 2 THEN CAST(ps[{a} + 2] AS DOUBLE) / 3600 ELSE 0 END"
_TEMPLATES = f"""
every AS (SELECT title AS page, raw FROM raw UNION ALL SELECT 'document ' || doc_id, text FROM documents WHERE text IS NOT NULL),
hits AS (SELECT page, raw, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT page, raw, regexp_extract_all(raw, {_lit(_RE2)}, 0) AS ts FROM every)),
around AS (SELECT page, i, t, raw[greatest(1, strpos(raw, t) - 10):strpos(raw, t) - 1] AS pre, raw[strpos(raw, t) + length(t):strpos(raw, t) + length(t) + 9] AS post FROM hits),
parts AS (SELECT page, i, list_filter(list_transform(string_split(regexp_replace(regexp_extract(regexp_replace(t, '&lt;.*?&gt;', '', 'g'), {_lit(INNER)}, 0), '[}}]+ *$', '|'), '|'), lambda x: lower(trim(x))), lambda x: length(x) > 0) AS ps
  FROM around WHERE NOT (contains(lower(pre), '&lt;') AND contains(lower(post), '&gt;')) AND (NOT contains(t, 'globe') OR contains(t, 'globe:earth'))),
marks AS (SELECT *, greatest(coalesce(list_position(ps, 'n'), 0), coalesce(list_position(ps, 's'), 0)) AS ns, greatest(coalesce(list_position(ps, 'e'), 0), coalesce(list_position(ps, 'w'), 0)) AS ew FROM parts),
found AS (
  SELECT page, i, CASE WHEN ps[ns] = 's' THEN -1 ELSE 1 END * ({_DEGREES.format(a='1', n='(ns - 1)')}) AS lat, CASE WHEN ps[ew] = 'w' THEN -1 ELSE 1 END * ({_DEGREES.format(a='(ns + 1)', n='(ew - ns - 1)')}) AS lon
  FROM marks WHERE ns BETWEEN 2 AND 4 AND ew - ns BETWEEN 2 AND 4
  UNION ALL SELECT page, i, CAST(ps[1] AS DOUBLE), CAST(ps[2] AS DOUBLE) FROM marks WHERE ns = 0 AND ew = 0 AND len(ps) = 2)
"""


@_query(f"WITH {_PAGES}, {_TEMPLATES} SELECT page, round(max_by(lat, i), 6) AS lat, round(max_by(lon, i), 6) AS lon FROM found GROUP BY page")
def template_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in the coordinate templates of the pages and of the documents."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("page"), F.col("text").alias("raw"))
    both = _raw_pages(spark, sf).withColumnRenamed("title", "page").unionByName(docs)
    p = both.select("page", template_position(F.col("raw")).alias("p")).where("p is not null")
    return p.select("page", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


# -- statements ------------------------------------------------------------------------------------------

_TITLE_OF = "replace(replace(replace(trim({}), ' ', '_'), '&quot;', '\"'), '&amp;', '&')"
_H = "(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))"
_LINKED = "contains(win, '[[' || lower(replace({0}, '_', ' ')) || '|') OR contains(win, '[[' || lower(replace({0}, '_', ' ')) || ']]')"
_AT = f"""
phrase AS (SELECT title, raw, clean, unnest([{", ".join(map(_lit, signals.PHRASES))}]) AS phrase FROM clean),
here AS (SELECT *, strpos(clean, phrase) AS pos1 FROM phrase WHERE strpos(clean, phrase) > 0),
lead AS (SELECT * FROM here WHERE strpos(clean, '.') > pos1 AND len(string_split_regex(regexp_replace(clean[1:pos1 - 1], '\\s+$', ''), '\\s')) < 30),
line AS (SELECT title, phrase, pos1, string_split_regex(clean[pos1 + length(phrase):pos1 + length(phrase) + 149], '(\\n\\s+\\n)|(==.*?==)')[1] AS line,
  CASE WHEN strpos(lower(raw), phrase) > 0 THEN raw[strpos(lower(raw), phrase):strpos(lower(raw), phrase) + 299] ELSE '' END AS window1 FROM lead),
near AS (SELECT * FROM line WHERE NOT regexp_matches(lower(line), '\\d{{2,}}\\s+(nautical\\s+)?(km|kilomet|mile)') AND NOT regexp_matches(lower(window1), '\\{{\\{{convert\\|\\d{{2,}}\\|')),
ent AS (SELECT DISTINCT title, phrase, {_TITLE_OF.format('n')} AS e FROM (SELECT title, phrase, unnest(regexp_extract_all(window1, '\\[\\[(.*?)(\\||(\\]\\]))', 1)) AS n FROM near)),
ent2 AS (SELECT title, phrase, e FROM ent UNION SELECT ent.title, phrase, target FROM ent JOIN hops ON hops.title = e),
placed AS (SELECT DISTINCT ent2.title, phrase, lat, lon FROM ent2 JOIN pos ON pos.title = e WHERE length(e) % 7 >= 3),
far AS (SELECT DISTINCT a.title, a.phrase FROM placed a JOIN placed b ON a.title = b.title AND a.phrase = b.phrase WHERE 2 * 6371 * atan2(sqrt(least(1, {_H})), sqrt(1 - least(1, {_H}))) > 5000),
ok AS (SELECT title, phrase, pos1, lower(window1) AS win, string_split_regex(line, '\\s') AS ws FROM near WHERE (title, phrase) NOT IN (SELECT (title, phrase) FROM far)),
start AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM ok),
gram AS (SELECT title, phrase, pos1, win, i, j, regexp_replace(trim(array_to_string(ws[i:j], '_')), '[,.;?!\\-%#]$', '') AS g
  FROM (SELECT *, unnest(range(i, len(ws) + 1)) AS j FROM start WHERE length(ws[i]) > 0 AND coalesce(lower(ws[i - 1]), '') <> 'new')),
named AS (SELECT title, phrase, pos1, win, i, j, upper(g[1]) || g[2:] AS e FROM gram WHERE length(g) > 0),
hit AS (SELECT named.*, target FROM named LEFT JOIN hops ON hops.title = e WHERE ({_LINKED.format('e')}) OR target IS NOT NULL AND ({_LINKED.format('target')})),
last AS (SELECT title, pos1, i, CASE WHEN e IN (SELECT title FROM pos) THEN e WHEN target IN (SELECT title FROM pos) THEN target END AS location FROM hit
  QUALIFY row_number() OVER (PARTITION BY title, phrase, pos1, i ORDER BY j DESC) = 1)
"""


@_query(f"WITH {_PARSED}, {_AT} SELECT title, location FROM last WHERE location IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos1, i) = 1")
def located_at(spark: SparkSession, sf: str) -> DataFrame:
    """Where the pages say that their subject is located."""
    return signals.located_at(_pages(spark, sf), _hops(spark, sf), _spots(spark, sf), _priorities(spark, sf))


_ENDS = "(ends_with(w, ']].') OR ends_with(w, '.') AND NOT starts_with(w, '[['))"
_REST = "s"
for _pattern, _put in signals.IS_A_SCRUB:
    _REST = f"regexp_replace({_REST}, {_lit(_pattern)}, {_lit(_put)}, 'g')"
_IS_A = f"""
own AS (SELECT title, raw, '''''''' || replace(title, '_', ' ') || '''''''' AS bold FROM raw WHERE NOT regexp_matches(title, '[?*+]')),
rest AS (SELECT title, substr(raw, strpos(raw, bold) + length(bold)) AS s FROM own WHERE strpos(raw, bold) > 0 AND title IN (SELECT title FROM spot)),
cut AS (SELECT title, ({_REST})[1:300] AS s FROM rest),
sure AS (SELECT title, string_split_regex(s, '\\s') AS ws FROM cut WHERE NOT regexp_matches(s, {_lit(signals.IS_A_DISTANCE)}) AND NOT contains(s, '---LOCATION DELETE---')),
word AS (SELECT title, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM sure),
verb AS (SELECT title, min(i) AS v FROM word WHERE i <= 50 AND length(w) > 1 AND (lower(w) IN ('is', 'was', 'are', 'were') OR {_ENDS}) GROUP BY title),
prep AS (SELECT word.title, min(i) AS p FROM word JOIN verb ON verb.title = word.title AND i > v WHERE lower(ws[v]) IN ('is', 'was', 'are', 'were') AND (lower(w) IN ('in', 'on', 'at') OR {_ENDS}) GROUP BY word.title),
stop AS (SELECT word.title, ws, p, min(i) AS q FROM word JOIN prep ON prep.title = word.title AND i > p WHERE lower(ws[p]) IN ('in', 'on', 'at') AND {_ENDS} GROUP BY word.title, ws, p),
ent AS (SELECT title, unnest(es) AS e, unnest(range(0, len(es))) AS k FROM (SELECT title, regexp_extract_all(array_to_string(ws[p + 1:q], ' '), '\\[\\[(.*?)(\\||(\\]\\]))', 1) AS es FROM stop))
"""


@_query(f"WITH {_PAGES}, spot AS (SELECT DISTINCT title FROM raw UNION SELECT title FROM pos), {_IS_A} SELECT ent.title, coalesce(target, {_TITLE_OF.format('e')}) AS location, CAST(k AS INT) AS pos FROM ent LEFT JOIN hops ON hops.title = {_TITLE_OF.format('e')} WHERE coalesce(target, {_TITLE_OF.format('e')}) IN (SELECT title FROM spot)")
def is_a_in(spark: SparkSession, sf: str) -> DataFrame:
    """What places the pages say that their subject is in (every page has a position here)."""
    p = _raw_pages(spark, sf)
    return signals.is_a_in(p, _hops(spark, sf), _spots(spark, sf).unionByName(p.select("title", F.lit(0.5).alias("lat"), F.lit(0.5).alias("lon"))))


# -- named locations -------------------------------------------------------------------------------------

_IN = lambda marks: "[" + ", ".join(_lit(m) for m in marks) + "]"


def _count_sql(text: str, variant: str) -> str:
    """How often a variant stands between delimiters: the pieces around it end and begin with such."""
    ps = f"string_split({text}, {variant})"
    return f"len(list_filter(range(1, len({ps})), lambda i: list_contains({_IN(BEFORE)}, CASE WHEN length({ps}[i]) > 0 THEN {ps}[i][-1] ELSE {variant}[-1] END) AND list_contains({_IN(AFTER)}, CASE WHEN length({ps}[i + 1]) > 0 THEN {ps}[i + 1][1] ELSE {variant}[1] END)))"


_NAMED = f"""
body AS (SELECT title, text, lower(CASE WHEN b BETWEEN 1 AND 51 THEN CASE WHEN e BETWEEN 1 AND 101 THEN substr(clean, CAST(b + e + 5 AS BIGINT)) ELSE substr(clean, CAST(b + 3 AS BIGINT)) END ELSE clean END) AS body
  FROM (SELECT *, strpos(substr(clean, CAST(b + 3 AS BIGINT)), '''''''') AS e FROM (SELECT *, strpos(clean, '''''''') AS b FROM clean))),
links AS (SELECT title, body, string_split(l, '|') AS ps FROM (SELECT title, body, unnest(regexp_extract_all(text, '\\[\\[ *(.*?) *\\]\\]', 1)) AS l FROM body) WHERE NOT contains(l, ':') AND length(l) > 0),
named AS (SELECT title, body, trim(ps[1]) AS name, list_distinct(flatten(list(list_transform(ps, lambda p: lower(trim(p)))))) AS vs FROM links WHERE length(trim(ps[1])) > 0 AND lower({_TITLE_OF.format('ps[1]')}) <> lower(title) GROUP BY ALL),
grouped AS (SELECT title, any_value(body) AS body, name, list_distinct(flatten(list(vs))) AS vs FROM named GROUP BY title, name),
piece AS (SELECT *, string_split(body, lower(name)) AS ps FROM grouped),
met AS (SELECT *, list_filter(range(1, len(ps)), lambda i: NOT ends_with(list_reduce(ps[1:i], lambda x, y: x || lower(name) || y), ' new '))[1] AS i FROM piece),
placed AS (SELECT title, {_TITLE_OF.format('name')} AS e, body, list_filter(vs, lambda v: length(v) > 0) AS vs, len(string_split_regex(trim(list_reduce(ps[1:i], lambda x, y: x || lower(name) || y)), '\\s')) AS ord FROM met WHERE i IS NOT NULL),
known AS (SELECT p.title, e, CASE WHEN e IN (SELECT title FROM pos) THEN e ELSE target END AS location, body, ord, unnest(list_filter(vs, lambda v: len(list_filter(vs, lambda w: w <> v AND contains(v, w))) = 0)) AS v
  FROM placed p LEFT JOIN hops ON hops.title = e),
counted AS (SELECT title, location, {_count_sql("(' ' || body || ' ')", 'v')} AS n, ord FROM known WHERE location IN (SELECT title FROM pos))
"""


@_query(f"WITH {_PARSED}, {_NAMED} SELECT title, e AS entity, array_to_string(list_sort(vs), '|') AS variants, CAST(ord AS INT) AS ord FROM placed")
def page_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Linked names of the pages with their variants and first mentions."""
    e = entities.page_entities(_pages(spark, sf))
    return e.select("title", "entity", F.array_join(F.sort_array("variants"), "|").alias("variants"), "ord")


@_query(f"WITH {_PARSED}, {_NAMED} SELECT title, location, CAST(sum(n) AS BIGINT) AS cnt, CAST(min(ord) AS INT) AS ord FROM counted GROUP BY title, location HAVING sum(n) > 0 AND min(ord) <= 250")
def page_named_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Geolocated links of the pages, with counts."""
    return entities.named_locations(_pages(spark, sf), _hops(spark, sf), _spots(spark, sf)).select("title", "location", F.col("cnt").cast("long").alias("cnt"), "ord")


@_query(f"WITH d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS x, lower(replace(trim(main_location, '_'), '_', ' ')) AS v FROM documents WHERE text IS NOT NULL AND main_location IS NOT NULL) SELECT doc_id, CAST({_count_sql('x', 'v')} AS INT) AS n FROM d WHERE length(v) > 0")
def variant_count(spark: SparkSession, sf: str) -> DataFrame:
    """How often each text names its main location."""
    from atlaswright.functions.text import occurrences

    d = table(spark, sf, "documents").where("text is not null and main_location is not null").withColumn("v", F.lower(F.replace(F.trim("main_location", F.lit("_")), F.lit("_"), F.lit(" "))))
    return d.where(F.length("v") > 0).select("doc_id", occurrences(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), F.col("v")).alias("n"))


# -- types -----------------------------------------------------------------------------------------------

_PLURALS = {t: "|".join(w.replace(" ", "_") for w in ws if w.endswith("s")) for t, ws in VARIANTS.items()}
_BY_CATEGORY = "CASE " + " ".join(
    f"WHEN len(list_filter(low, lambda c: regexp_matches(c, '^({p})$') OR regexp_matches(c, '^({p})') AND regexp_matches(c, '_(in|of)_'))) > 0 THEN '{t}'" for t, p in _PLURALS.items() if p
) + f" WHEN len(list_filter(cs, lambda c: regexp_matches(c, '{PERSON_CATEGORIES}'))) > 0 THEN 'PERSON' END"
_OWNERS = ", ".join(f"('{v}', '{t}', {PRIORITY[t]}, {n})" for n, t in enumerate(TYPES) for v in VARIANTS[t])
_LOWER = "lower(regexp_replace(replace(regexp_replace(regexp_replace(coalesce(clean, ''), '[''`;,?!]', '', 'g'), '[_@\\-\\t/\\\\]', ' ', 'g'), '.', ' '), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g'))"
_WORDS = f"list_filter(string_split_regex(trim(regexp_replace({_LOWER}, '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 0 AND NOT regexp_full_match(x, '\\d+'))[1:50]"
_VALID = "CASE {0} WHEN 'COUNTRY' THEN len(list_filter(lows, lambda c: starts_with(c, 'countries') AND regexp_matches(c, '_(in|of)_'))) > 0 WHEN 'STATE' THEN len(list_filter(lows, lambda c: starts_with(c, 'states') AND regexp_matches(c, '_(in|of)_'))) > 0 ELSE {0} IS NOT NULL END"
_TYPED = f"""
own AS (SELECT variant, type, priority, ordinal FROM (VALUES {_OWNERS}) x(variant, type, priority, ordinal)),
first AS (SELECT variant, min_by(type, ordinal) AS type FROM own GROUP BY variant),
prio AS (SELECT DISTINCT type, priority FROM own),
doc AS (SELECT k, title, raw, cs, list_transform(cs, lambda c: trim(lower(regexp_replace(c, '^[0-9_-]+', '')))) AS low, list_transform(cs, lambda c: lower(c)) AS lows, {_WORDS} AS ws FROM pages),
box AS (SELECT k, type FROM (
  SELECT d.k, o.type, o.priority, d.i, o.ordinal FROM (SELECT k, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT k, list_transform(string_split(regexp_replace(trim(regexp_extract(raw, '\\| *settlement_type *=(.*?)\\n', 1)), '^\\[\\[|\\]\\]$', '', 'g'), '|'), lambda p: trim(regexp_replace(trim(lower(p)), '^list of ', ''))) AS ps FROM doc)) d
    JOIN own o ON CASE WHEN contains(p, ' capital') THEN o.type = 'SETTLEMENT' ELSE starts_with(p, o.variant) END)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority DESC, i DESC, ordinal DESC) = 1),
verb AS (SELECT k, min(list_position(ws, v)) AS v FROM doc, (SELECT unnest([{", ".join(map(_lit, VERBS))}]) AS v) WHERE list_contains(ws, v) GROUP BY k),
step AS (SELECT doc.k, lows, j, ws[v + j] AS w, a.type AS one, b.type AS two, pa.priority AS p1, pb.priority AS p2, v + j > 1 AND w = 'states' AND ws[v + j - 1] = 'united' AS us
  FROM (SELECT *, unnest(range(0, 5)) AS j FROM doc JOIN verb USING (k)) doc LEFT JOIN first a ON a.variant = ws[v + j] LEFT JOIN first b ON b.variant = ws[v + j + 1] LEFT JOIN prio pa ON pa.type = a.type LEFT JOIN prio pb ON pb.type = b.type),
said AS (SELECT k, j, w IS NULL OR w IN ({", ".join(map(_lit, STOP_AT))}) AS stop, CASE WHEN one IS NULL OR coalesce(us, FALSE) THEN NULL WHEN two IS NOT NULL AND p2 > p1 AND {_VALID.format('two')} THEN two WHEN {_VALID.format('one')} THEN one END AS type FROM step),
told AS (SELECT k, CASE WHEN NOT stop THEN type END AS type FROM said WHERE stop OR type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY j) = 1),
typed AS (SELECT doc.k, doc.title, coalesce({_BY_CATEGORY}, box.type, told.type,
    CASE WHEN ends_with(lower(title), 'ship)') AND NOT regexp_matches(lower(title), '(scholarship|fellowship|ownership|membership)\\)$') THEN 'SHIP' END, 'NONE') AS type
  FROM doc LEFT JOIN box ON box.k = doc.k LEFT JOIN told ON told.k = doc.k)
"""
_PAGE_CATS = "list_transform(regexp_extract_all(raw, '\\[\\[[Cc]ategory *: *(.*?)(\\||\\]\\])', 1), lambda c: replace(trim(regexp_replace(c, '#.*$', '', 's')), ' ', '_'))"


@_query(f"WITH {_PARSED}, pages AS (SELECT title AS k, title, raw, clean, {_PAGE_CATS} AS cs FROM clean), {_TYPED} SELECT title, type FROM typed")
def page_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the pages by the whole cascade."""
    p = _pages(spark, sf)
    return p.select("title", article_type(F.col("title"), F.col("raw"), F.col("clean"), F.col("categories")).alias("type"))


_DOC_TYPES = f"""
kc AS (SELECT DISTINCT title, {_reading('category')} AS category FROM categories WHERE title IS NOT NULL AND {_reading('category')} IS NOT NULL),
kl AS (SELECT title, list(category) AS cs FROM kc GROUP BY title),
dt AS (SELECT doc_id, title, text FROM documents WHERE title IS NOT NULL), {_clean_sql('dt', 'text')},
pages AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 't' || kl.title) AS k, doc_id, coalesce(clean.title, kl.title) AS title, text AS raw, clean, coalesce(cs, []) AS cs FROM clean FULL JOIN kl ON kl.title = clean.title), {_TYPED}
"""


def type_sql() -> str:
    """SQL of the types of all documents and of titles that have categories only."""
    return f"WITH {_DOC_TYPES} SELECT doc_id, typed.title, type FROM typed JOIN pages ON pages.k = typed.k"
