"""Queries over the test tables, one for each operator or family, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.config import Weights
from atlaswright.functions.coordinate_templates import template_position
from atlaswright.functions.geo import haversine_km
from atlaswright.functions.porter import stemmed
from atlaswright.functions.readings import category_reading
from atlaswright.functions.text import STOP_WORDS, article_title, irreducible, normal_title, occurrences, tokens, without_stop_words
from atlaswright.functions.wikitext import clean_text, links, without_dropped_lines
from atlaswright.operators import category_graph, category_stats, neighbors, signals, vectors, weights
from atlaswright.operators.article_types import VARIANTS, article_type, type_from_categories
from atlaswright.operators.articles import assemble
from atlaswright.operators.entities import located_names
from atlaswright.operators.hierarchy import category_links
from atlaswright.operators.proximity import current_positions
from atlaswright.plans.core_queries import _POSITIONS, _reading, table
from atlaswright.plans.pages import type_sql
from atlaswright.plans.porter_sql import STEMS
from atlaswright.session import cut, scratch_dir
from atlaswright.sources.writers import row_json, value_json, vector_json, write_neighbors

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
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


# -- tables as the operators take them ---------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.clean_counts(table(spark, sf, "article_words"))


def _cats(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """With ``by``, rows are shuffled by these columns."""
    c = table(spark, sf, "categories").select("title", category_reading(F.col("category")).alias("category"))
    c = c.where("title is not null and category is not null")
    return (c.repartition(*by) if by else c).distinct()


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return current_positions(table(spark, sf, "coordinates"))


def _locations(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.usable_locations(table(spark, sf, "named_locations"))


_LOWER = "lower(regexp_replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '[''`;,?!]', '', 'g'), '[_@\\-\\t/\\\\]', ' ', 'g'), '.', ' '), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g'))"
_TOKENS = f"list_filter(string_split_regex(trim(regexp_replace({_LOWER}, '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 0 AND NOT regexp_full_match(x, '\\d+'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

_COUNTS = """
counts AS (
  SELECT title, word, sum(tf) AS tf FROM (
    SELECT DISTINCT title, lower(word) AS word, tf FROM article_words WHERE title IS NOT NULL AND word IS NOT NULL AND word <> '' AND tf >= 1)
  GROUP BY title, word),
dict AS (SELECT word, count(*) AS df FROM counts GROUP BY word),
total AS (SELECT count(DISTINCT title) AS n_docs, sum(tf) AS n_words FROM counts)
"""
_VECTORS = f"""{_COUNTS},
scored AS (SELECT title, c.word, log10(1 + tf) * log10(n_docs / df) AS score FROM counts c JOIN dict d ON c.word = d.word, total),
kept AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, word) <= 20),
words AS (SELECT title, word, CASE WHEN sum(score * score) OVER (PARTITION BY title) > 0 THEN score / sqrt(sum(score * score) OVER (PARTITION BY title)) ELSE 0 END AS score FROM kept)
"""
_CATS = f"cats AS (SELECT DISTINCT title, {_reading('category')} AS category FROM categories WHERE title IS NOT NULL AND {_reading('category')} IS NOT NULL)"
_LOCS = """
locs AS (
  SELECT title, location, CAST(sum(cnt) AS BIGINT) AS cnt, min(ord) AS ord FROM (
    SELECT DISTINCT title, nullif(regexp_replace(regexp_replace(location, '^[\\s_]+|[\\s_]+$', '', 'g'), '\\s', '_', 'g'), '') AS location, cnt, ord FROM named_locations
    WHERE title IS NOT NULL AND cnt >= 1 AND ord BETWEEN 0 AND 250)
  WHERE location IS NOT NULL GROUP BY title, location),
shares AS (SELECT title, location, ord, sqrt(cnt / sum(cnt) OVER (PARTITION BY title)) AS score FROM locs),
topl AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, ord, location) <= 20),
locv AS (SELECT title, location, score / sqrt(sum(score * score) OVER (PARTITION BY title)) AS score FROM topl)
"""


def _dist(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt(least(1.0, {h})), sqrt(1 - least(1.0, {h}))))"


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, title, type`` of every document with a title, and of titles that have categories only (without doc_id)."""
    cats = _cats(spark, sf).groupBy("title").agg(F.collect_list("category").alias("categories"))
    docs = _docs(spark, sf).where("title is not null").select("doc_id", "title", "text", "revised_at", clean_text(F.col("text"), F.col("title")).alias("clean"))
    pages, _ = cut(docs.join(cats, "title", "full"), "pages")  # the cascade reads clean text many times
    kind = article_type(F.col("title"), F.col("text"), F.col("clean"), F.col("categories"))
    return pages.select("doc_id", "title", kind.alias("type"), "revised_at")


# -- pages and text ------------------------------------------------------------------------------------

_ARTICLE = "NOT regexp_matches(lower(title), 'wikipedia:|file:|portal:|template:|category:') AND NOT ends_with(regexp_replace(lower(title), '[\\s_]', '', 'g'), '(disambiguation)') AND NOT starts_with(regexp_replace(lower(title), '[\\s_]', '', 'g'), 'listof')"


@_query(f"SELECT doc_id, title FROM documents WHERE title IS NOT NULL AND {_ARTICLE}")
def scan_filter_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(article_title(F.col("title"))).select("doc_id", "title")


@_query("SELECT doc_id, replace(replace(replace(trim(title), ' ', '_'), '&quot;', '\"'), '&amp;', '&') AS title FROM documents")
def title_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", normal_title(F.col("title")).alias("title"))


@_query("SELECT doc_id, trim(string_split(l, '|')[1]) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[ *(.*?) *\\]\\]', 1)) AS l FROM documents) WHERE NOT contains(l, ':') AND length(l) > 0")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(links(F.col("text"))).alias("l")).select("doc_id", F.trim(F.col("l")[0]).alias("target"))


@_query(
    "SELECT doc_id, target, min(i) AS first, count(*) AS n FROM (SELECT doc_id, trim(string_split(l, '|')[1]) AS target, i - 1 AS i FROM ("
    "SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '\\[\\[ *(.*?) *\\]\\]', 1), lambda x: NOT contains(x, ':') AND length(x) > 0) AS ls FROM documents)))"
    " GROUP BY doc_id, target"
)
def link_first_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    each = _docs(spark, sf).select("doc_id", F.posexplode(links(F.col("text"))).alias("i", "l")).select("doc_id", F.trim(F.col("l")[0]).alias("target"), F.col("i").cast("long").alias("i"))
    return each.groupBy("doc_id", "target").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))


@_query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(Category:|\\||!|\\*|#|Image:)')), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def line_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("text is not null").select("doc_id", without_dropped_lines(F.col("text")).alias("text"))


@_query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS words FROM documents")
def tokenise_no_stem(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("words"))


@_query(f"SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)), ' ') AS words FROM documents")
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(without_stop_words(tokens(F.col("text"))), " ").alias("words"))


@_query(
    f"WITH words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, {_TOKENS} AS ws FROM documents)), st0 AS (SELECT DISTINCT w FROM words), {STEMS}"
    f" SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (length(s) >= 3 AND NOT list_contains({_STOP}, s)), '') AS stems FROM documents d LEFT JOIN (SELECT doc_id, i, s FROM words JOIN stems ON stems.w = words.w) x ON x.doc_id = d.doc_id GROUP BY d.doc_id"
)
def porter_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(without_stop_words(stemmed(tokens(F.col("text")))), " ").alias("stems"))


@_query(f"SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents) GROUP BY word")
def text_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    words = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


# -- dictionaries and vectors ----------------------------------------------------------------------------


@_query(f"WITH {_COUNTS} SELECT word, df FROM dict")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.dictionary(_counts(spark, sf))


@_query(f"WITH {_COUNTS} SELECT n_docs, CAST(n_words AS BIGINT) AS n_words FROM total")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.corpus_totals(_counts(spark, sf))


@_query(f"WITH {_COUNTS} SELECT title, word, CAST(tf AS BIGINT) AS tf FROM counts")
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@_query(f"WITH {_COUNTS} SELECT word, df, round(log10(n_docs / df), 9) AS idf FROM dict, total")
def idf(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.idf(_counts(spark, sf)).withColumn("idf", F.round("idf", 9))


@_query(f"WITH {_VECTORS} SELECT title, word, round(score, 6) AS score FROM words")
def tfidf_top20(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.word_vectors(_counts(spark, sf)).withColumn("score", F.round("score", 6))


@_query(f"WITH {_LOCS} SELECT title, location, round(score, 6) AS score FROM locv")
def location_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.location_vectors(_locations(spark, sf)).withColumn("score", F.round("score", 6))


@_query(f"WITH {_COUNTS} SELECT word, dense_rank() OVER (ORDER BY word) - 1 AS id FROM dict")
def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.dense_ids(_counts(spark, sf), "word")


# -- postings, candidates, neighbours --------------------------------------------------------------------


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.postings(vectors.word_vectors(_counts(spark, sf)), vectors.location_vectors(_locations(spark, sf)), _cats(spark, sf), _positions(spark, sf))


_POST = f"""{_VECTORS}, {_CATS}, {_LOCS}, {_POSITIONS},
post AS (
  SELECT 'words' AS feature, word AS term, title, score FROM words UNION ALL SELECT 'locations', location, title, score FROM locv UNION ALL SELECT 'categories', category, title, 1.0 FROM cats),
index AS (SELECT * FROM post WHERE title IN (SELECT title FROM pos))
"""
_COMMON = "common AS (SELECT a.title, b.title AS neighbor, a.feature, count(*) AS n, sum(a.score * b.score) AS dot FROM post a JOIN index b ON a.feature = b.feature AND a.term = b.term AND a.title <> b.title GROUP BY ALL)"


@_query(f"WITH {_POST} SELECT feature, term, count(*) AS n, count(*) FILTER (title IN (SELECT title FROM pos)) AS n_located, min(title) AS first, CAST(sum(trunc(round(score * 1000000, 3))) AS BIGINT) AS points FROM post GROUP BY feature, term")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _postings(spark, sf).withColumn("p", F.round(F.col("score") * 1_000_000, 3).cast("long"))
    return rows.groupBy("feature", "term").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has_coords"), 1)).alias("n_located"), F.min("title").alias("first"), F.sum("p").alias("points"))


@_query(f"""WITH {_POST} SELECT feature, term, 0 AS segment, CAST(to_json(list(struct_pack(title := title, score := CAST(trunc(round(score * 1000000, 3)) AS INT)) ORDER BY title)) AS VARCHAR) AS list FROM post GROUP BY feature, term""")
def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    """All lists; none is long enough here for a second segment."""
    return neighbors.posting_lists(_postings(spark, sf)).select("feature", "term", "segment", F.to_json("list").alias("list"))


@_query(f"WITH {_POST}, {_COMMON} SELECT title, neighbor, n FROM common WHERE feature = 'words' AND n >= 2")
def posting_prune_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = _postings(spark, sf).where("feature = 'words'")
    return neighbors.pairs_in_common(rows, {"words": 2}, "words")


@_query(f"WITH {_POST}, {_COMMON} SELECT DISTINCT title, neighbor FROM common WHERE feature = 'words' AND n >= 2 OR feature <> 'words' AND n >= 1")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.pairs_in_common(_postings(spark, sf), {"words": 2, "locations": 1, "categories": 1})


@_query(f"WITH {_POST}, {_COMMON} SELECT title, neighbor, round(dot, 6) AS cosine FROM common WHERE feature = 'words' AND round(dot, 6) >= 0.1")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbors.similar_titles(_postings(spark, sf), "words", 0.0999995).withColumn("cosine", F.round("score", 6))
    return pairs.where("cosine >= 0.1").select("title", "neighbor", "cosine")


@_query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, round(list_sum(list_transform(range(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * embedding[i + 1])), 6) AS shifted FROM embeddings")
def dense_vectors(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return d.select("vec_id", "label", F.round(F.sqrt(dot(F.col("e"), F.col("e"))), 6).alias("norm"), F.round(dot(F.col("e"), F.slice("e", F.lit(2), F.size("e"))), 6).alias("shifted"))


@_query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
    u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
    c AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
      WHERE a.norm > 0 AND b.norm > 0 AND isfinite(a.norm) AND isfinite(b.norm))
    SELECT id_a, id_b, cosine FROM c WHERE cosine >= 0.1""")
def cosine_dense(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.dense_cosines(rows).withColumn("cosine", F.round("cosine", 6))


@_query(f"""WITH {_CATS}, {_POSITIONS}, held AS (SELECT title, category, count(*) OVER (PARTITION BY title) AS k FROM cats),
    common AS (SELECT a.title, b.title AS neighbor, count(*) AS c, any_value(a.k) AS ka, any_value(b.k) AS kb FROM held a JOIN held b ON a.category = b.category AND a.title <> b.title WHERE b.title IN (SELECT title FROM pos) GROUP BY a.title, b.title)
    SELECT title, neighbor, round(c / (ka + kb - c), 6) AS jaccard FROM common WHERE round(c / (ka + kb - c), 6) >= 0.5""")
def jaccard_categories(spark: SparkSession, sf: str) -> DataFrame:
    cats = _cats(spark, sf)
    rows = cats.select(F.lit("categories").alias("feature"), F.col("category").alias("term"), "title", F.lit(1.0).alias("score"))
    known = _positions(spark, sf).select("title", F.lit(True).alias("has_coords"))
    rows = rows.join(known, "title", "left").withColumn("has_coords", F.coalesce("has_coords", F.lit(False)))
    pairs = neighbors.similar_titles(rows, "categories", 0.4999995).withColumn("jaccard", F.round("score", 6))
    return pairs.where("jaccard >= 0.5").select("title", "neighbor", "jaccard")


_KNN = f"""{_POST},
query AS (SELECT * FROM post UNION ALL SELECT 'locations', location, title, 0.0 FROM locs WHERE (title, location) NOT IN (SELECT (title, location) FROM locv)),
pair AS (
  SELECT a.title, b.title AS neighbor,
    count(*) FILTER (a.feature = 'words') AS n_w, coalesce(sum(a.score * b.score) FILTER (a.feature = 'words'), 0) AS dot_w,
    count(*) FILTER (a.feature = 'locations') AS n_l, coalesce(sum(a.score * b.score) FILTER (a.feature = 'locations'), 0) AS dot_l,
    count(*) FILTER (a.feature = 'categories') AS n_c
  FROM query a JOIN index b ON a.feature = b.feature AND a.term = b.term AND a.title <> b.title GROUP BY a.title, b.title),
held AS (SELECT title, count(*) AS k FROM cats GROUP BY title),
blend AS (
  SELECT p.title, neighbor, (dot_w + dot_l + n_c / nullif(coalesce(x.k, 0) + coalesce(y.k, 0) - n_c, 0)) / 3 AS score
  FROM pair p LEFT JOIN held x ON x.title = p.title LEFT JOIN held y ON y.title = neighbor WHERE n_w >= 2 OR n_l >= 1 OR n_c >= 1),
near AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY round(score, 9) DESC, neighbor) AS rank FROM blend WHERE CAST(CAST(score AS FLOAT) AS DOUBLE) >= 0.1)
"""


def _near(spark: SparkSession, sf: str, w: Weights = Weights()) -> DataFrame:
    locs = _locations(spark, sf)
    return neighbors.nearest_neighbors(vectors.word_vectors(_counts(spark, sf)), vectors.location_vectors(locs), locs, _cats(spark, sf), _positions(spark, sf), w)


@_query(f"WITH {_KNN} SELECT title, neighbor, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM near WHERE rank <= 100")
def knn_blended(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).withColumn("score", F.round("score", 6))


@_query(f"WITH {_POST}, {_COMMON}, s AS (SELECT title, neighbor, dot, row_number() OVER (PARTITION BY title ORDER BY round(dot, 9) DESC, neighbor) AS rank FROM common WHERE feature = 'words' AND n >= 2 AND CAST(CAST(dot AS FLOAT) AS DOUBLE) >= 0.1) SELECT title, neighbor, round(dot, 6) AS score, CAST(rank AS INT) AS rank FROM s WHERE rank <= 100")
def knn_words(spark: SparkSession, sf: str) -> DataFrame:
    locs = _locations(spark, sf)
    near = neighbors.nearest_neighbors(vectors.word_vectors(_counts(spark, sf)), vectors.location_vectors(locs), locs, _cats(spark, sf), _positions(spark, sf), Weights(1, 0, 0), drop_uncategorised_pairs=False)
    return near.withColumn("score", F.round("score", 6))


@_query(f"WITH {_POSITIONS} SELECT title, neighbor, count(*) AS n FROM neighbors WHERE title <> neighbor AND neighbor IN (SELECT title FROM pos) GROUP BY title, neighbor")
def verified_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.verified(table(spark, sf, "neighbors"), _positions(spark, sf)).where("title is not null").groupBy("title", "neighbor").agg(F.count(F.lit(1)).alias("n"))


# -- assembly and lookups --------------------------------------------------------------------------------


@_query(f"""WITH {_POST}, titles AS (SELECT DISTINCT title FROM words),
    c AS (SELECT title, count(*) AS n_categories FROM cats GROUP BY title), l AS (SELECT title, count(*) AS n_locations FROM locs GROUP BY title), w AS (SELECT title, count(*) AS n_words FROM words GROUP BY title)
    SELECT t.title, lat, lon, coalesce(n_categories, 0) AS n_categories, coalesce(n_locations, 0) AS n_locations, n_words
    FROM titles t LEFT JOIN pos ON pos.title = t.title LEFT JOIN c ON c.title = t.title LEFT JOIN l ON l.title = t.title LEFT JOIN w ON w.title = t.title""")
def assemble_articles(spark: SparkSession, sf: str) -> DataFrame:
    locs, cats = _locations(spark, sf), _cats(spark, sf)
    kinds = _types(spark, sf).groupBy("title").agg(F.max(F.struct("revised_at", "doc_id", "type"))["type"].alias("type"))
    empty = spark.createDataFrame([], "title string, location string, pos int")
    a = assemble(vectors.word_vectors(_counts(spark, sf)), _positions(spark, sf), locs, cats, kinds, empty.select("title", "location"), empty, vectors.location_vectors(locs))
    size = lambda c: F.size(c).cast("long")
    return a.select("title", "coords.lat", "coords.lon", size("categories").alias("n_categories"), size("named_locations").alias("n_locations"), size("words").alias("n_words"))


@_query(f"WITH {_LOCS}, {_POSITIONS}, hop AS (SELECT neighbor AS title, min(title) AS target FROM neighbors WHERE neighbor <> title GROUP BY neighbor), "
    "names AS (SELECT DISTINCT location AS name FROM locs) "
    "SELECT name, CASE WHEN name IN (SELECT title FROM pos) THEN name ELSE target END AS location FROM names LEFT JOIN hop ON hop.title = name WHERE name IN (SELECT title FROM pos) OR target IN (SELECT title FROM pos)")
def entity_or_redirect(spark: SparkSession, sf: str) -> DataFrame:
    names = _locations(spark, sf).select(F.col("location").alias("name")).distinct()
    hops = table(spark, sf, "neighbors").where("neighbor <> title").groupBy(F.col("neighbor").alias("title")).agg(F.min("title").alias("target"))
    return located_names(names, hops, _positions(spark, sf), "name").select("name", "location")


@_query("SELECT DISTINCT title FROM documents WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM article_views WHERE title IS NOT NULL)")
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("title is not null").select("title").distinct().join(table(spark, sf, "article_views").select("title"), "title", "left_anti")


@_query("SELECT DISTINCT title FROM documents WHERE title IN (SELECT title FROM coordinates)")
def semi_known(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("title").distinct().join(table(spark, sf, "coordinates").select("title"), "title", "left_semi")


_LISTS = f"{_CATS}, lists AS (SELECT title, list(DISTINCT lower(category)) AS vs FROM cats GROUP BY title)"


@_query(f"WITH {_LISTS} SELECT title, array_to_string(list_sort(list_filter(vs, lambda v: len(list_filter(vs, lambda w: w <> v AND contains(v, w))) = 0)), ',') AS variants FROM lists")
def variant_reduction(spark: SparkSession, sf: str) -> DataFrame:
    v = _cats(spark, sf).groupBy("title").agg(F.collect_set(F.lower("category")).alias("vs"))
    return v.select("title", F.array_join(F.sort_array(irreducible(F.col("vs"))), ",").alias("variants"))


# -- positions and categories ----------------------------------------------------------------------------

_PLACES = f"{_LOCS}, {_POSITIONS}, places AS (SELECT locs.title, location AS place, lat, lon FROM locs LEFT JOIN pos ON pos.title = location)"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """The places that each title names, with their current positions, if any."""
    spots = _positions(spark, sf).withColumnRenamed("title", "place")
    return _locations(spark, sf).select("title", F.col("location").alias("place")).join(spots, "place", "left")


@_query(f"WITH {_PLACES} SELECT a.title, a.place AS place_a, b.place AS place_b, CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN round({_dist('a', 'b')}, 6) END AS km FROM places a JOIN places b ON a.title = b.title AND a.place < b.place")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = _places(spark, sf)
    q = p.select("title", F.col("place").alias("place_b"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    return p.join(q, "title").where("place < place_b").select("title", F.col("place").alias("place_a"), "place_b", F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")), 6).alias("km"))


@_query(f"WITH {_PLACES}, found AS (SELECT * FROM places WHERE lat IS NOT NULL) SELECT title, round(max({_dist('a', 'b')}), 6) AS diameter FROM (SELECT a.title, a, b FROM found a JOIN found b ON a.title = b.title AND a.place <= b.place) GROUP BY title HAVING max({_dist('a', 'b')}) <= 12000")
def diameter_filter(spark: SparkSession, sf: str) -> DataFrame:
    g = _places(spark, sf).select(F.col("title").alias("key"), F.col("place").alias("name"), "lat", "lon")
    return category_stats.within_diameter(g, 12000).select(F.col("key").alias("title"), F.round("diameter", 6).alias("diameter"))


_UNITS = "CAST(round({} * 1e12) AS HUGEINT)"
_MEAN = "CASE WHEN {1} > 0 THEN ((({0} + {1}::HUGEINT * 1000000000000000) * 2 + {1} * 1000) // nullif({1}::HUGEINT * 2000, 0) - 1000000000000) / 1e9 END"
_STATS = f"""{_CATS}, {_POSITIONS},
m AS (SELECT category, cats.title, lat, lon FROM cats LEFT JOIN pos ON pos.title = cats.title),
mean AS (SELECT category, n_articles, n_located, {_MEAN.format('sum_lat', 'n_located')} AS lat, {_MEAN.format('sum_lon', 'n_located')} AS lon, sum_lat, sum_lon
  FROM (SELECT category, count(*) AS n_articles, count(lat) AS n_located, sum({_UNITS.format('lat')}) AS sum_lat, sum({_UNITS.format('lon')}) AS sum_lon FROM m GROUP BY category)),
disp AS (SELECT a.category, avg({_dist('a', 'b')}) AS dispersion FROM m a JOIN mean b ON a.category = b.category WHERE a.lat IS NOT NULL GROUP BY a.category),
stats AS (SELECT mean.* EXCLUDE (sum_lat, sum_lon), dispersion FROM mean LEFT JOIN disp ON disp.category = mean.category),
loo AS (SELECT m.category, m.title, {_MEAN.format(f"(sum_lat - {_UNITS.format('m.lat')})", '(n_located - 1)')} AS lat, {_MEAN.format(f"(sum_lon - {_UNITS.format('m.lon')})", '(n_located - 1)')} AS lon, n_located - 1 AS others
  FROM m JOIN mean b ON b.category = m.category WHERE m.lat IS NOT NULL),
lood AS (SELECT a.category, a.title, avg({_dist('b', 'a')}) AS dispersion FROM loo a JOIN m b ON a.category = b.category AND a.title <> b.title AND b.lat IS NOT NULL GROUP BY a.category, a.title)
"""


@_query(f"WITH {_STATS} SELECT category, n_articles, n_located, lat, lon, round(dispersion, 6) AS dispersion FROM stats")
def stats_of_categories(spark: SparkSession, sf: str) -> DataFrame:
    s = category_stats.category_stats(_cats(spark, sf), _positions(spark, sf))
    return s.select("category", "n_articles", "n_located", "lat", "lon", F.round("dispersion", 6).alias("dispersion"))


@_query(f"WITH {_STATS} SELECT category, title, lat, lon, others FROM loo")
def category_loo_mean(spark: SparkSession, sf: str) -> DataFrame:
    s = category_stats.leave_one_out_means(_cats(spark, sf), _positions(spark, sf))
    return s.select("category", "title", "lat", "lon", "others")


@_query(f"WITH {_STATS} SELECT category, title, round(dispersion, 6) AS dispersion FROM lood")
def category_loo_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    s = category_stats.leave_one_out_dispersions(_cats(spark, sf), _positions(spark, sf))
    return s.withColumn("dispersion", F.round("dispersion", 6))


@_query(f"""WITH {_STATS} SELECT c.category, c.title, CASE WHEN l.others IS NULL THEN s.lat ELSE l.lat END AS lat, CASE WHEN l.others IS NULL THEN s.lon ELSE l.lon END AS lon,
    round(CASE WHEN l.others IS NULL THEN s.dispersion ELSE d.dispersion END, 6) AS dispersion, n_located - (l.others IS NOT NULL)::INT AS n_located,
    round(CASE WHEN n_articles - (l.others IS NOT NULL)::INT > 0 THEN (n_located - (l.others IS NOT NULL)::INT) / (n_articles - (l.others IS NOT NULL)::INT + 1) ELSE 0 END, 9) AS ratio
    FROM cats c JOIN stats s ON s.category = c.category LEFT JOIN loo l ON l.category = c.category AND l.title = c.title LEFT JOIN lood d ON d.category = c.category AND d.title = c.title""")
def category_requester_view(spark: SparkSession, sf: str) -> DataFrame:
    cats = _cats(spark, sf, "title")  # as positions are
    v = category_stats.requester_view(cats, cats, _positions(spark, sf))
    return v.select("category", "title", "lat", "lon", F.round("dispersion", 6).alias("dispersion"), "n_located", F.round("ratio", 9).alias("ratio"))


# -- graphs ----------------------------------------------------------------------------------------------

_EDGES = f"""raw AS (SELECT parent, {_reading("kid")} AS child FROM (SELECT {_reading("category")} AS parent, unnest(subcategories) AS kid FROM subcategories)),
{_CATS}, names AS (SELECT DISTINCT category AS name FROM cats),
links AS (SELECT DISTINCT parent, child FROM raw WHERE parent <> child),
edges AS (SELECT parent, child FROM links WHERE parent IN (SELECT name FROM names) AND child IN (SELECT name FROM names))"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    names = _cats(spark, sf).select(F.col("category").alias("name")).distinct()
    return category_graph.known_edges(category_links(table(spark, sf, "subcategories"))[1], names)


@_query(f"WITH {_EDGES} SELECT parent, child FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@_query(f"""WITH RECURSIVE {_EDGES}, known AS (SELECT name FROM names UNION SELECT child FROM links JOIN known ON known.name = links.parent)
    SELECT DISTINCT parent, child FROM (SELECT parent, child FROM edges UNION SELECT parent, child FROM links WHERE parent IN (SELECT name FROM known) AND child IN (SELECT name FROM known))""")
def graph_augmented(spark: SparkSession, sf: str) -> DataFrame:
    names = _cats(spark, sf).select(F.col("category").alias("name")).distinct()
    return category_graph.augmented_edges(_edges(spark, sf), category_links(table(spark, sf, "subcategories"))[1], names)


@_query(f"""WITH RECURSIVE {_EDGES}, nodes AS (SELECT parent AS n FROM edges UNION SELECT child FROM edges),
    zero AS (SELECT DISTINCT title AS root, category FROM cats WHERE category IN (SELECT n FROM nodes)),
    up AS (SELECT root, 0 AS level, category FROM zero UNION SELECT root, level + 1, parent FROM up JOIN edges ON edges.child = up.category WHERE level < 3)
    SELECT root, 0 AS level, category FROM zero UNION ALL SELECT root, CAST(min(level) AS INT) AS level, category FROM up WHERE level >= 1 GROUP BY root, category""")
def graph_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    starts = _cats(spark, sf).select(F.col("title").alias("root"), "category")
    return category_graph.ancestors(_edges(spark, sf), starts, 4)


# -- types, signals, weights -----------------------------------------------------------------------------

_PLURALS = {t: "|".join(w.replace(" ", "_") for w in ws if w.endswith("s")) for t, ws in VARIANTS.items()}
_TYPE = "CASE " + " ".join(
    f"WHEN len(list_filter(low, lambda c: regexp_matches(c, '^({p})$') OR regexp_matches(c, '^({p})') AND regexp_matches(c, '_(in|of)_'))) > 0 THEN '{t}'" for t, p in _PLURALS.items() if p
) + " WHEN len(list_filter(cs, lambda c: regexp_matches(c, '\\d+s?_births|\\d+s?_deaths|People_(from|in|of)|Living_people|_alumni$'))) > 0 THEN 'PERSON' ELSE 'NONE' END"


@_query(f"WITH {_CATS}, l AS (SELECT title, list(category) AS cs, list(trim(lower(regexp_replace(category, '^[0-9_-]+', '')))) AS low FROM cats GROUP BY title) SELECT title, {_TYPE} AS type FROM l")
def type_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = _cats(spark, sf).groupBy("title").agg(F.collect_list("category").alias("c"))
    return c.select("title", F.coalesce(type_from_categories(F.col("c")), F.lit("NONE")).alias("type"))


@_query(type_sql())
def type_of_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade; ``type_cascade`` is its first rule."""
    return _types(spark, sf).select("doc_id", "title", "type")


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@_query(f"WITH {_VECTORS} SELECT title, '[' || string_agg('{{\"term\":\"' || word || '\",\"score\":' || CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR) || '}}', ',' ORDER BY round(score * 1000000) DESC, word) || ']' AS vector FROM words GROUP BY title")
def json_render(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors as JSON, with scores in millionths."""
    v = vectors.word_vectors(_counts(spark, sf)).groupBy("title").agg(F.collect_list(F.struct(F.col("word").alias("term"), F.round(F.col("score") * 1_000_000).cast("long").alias("score"))).alias("v"))
    return v.select("title", vector_json(F.col("v")).alias("vector"))


@_query(f"WITH {_STATS} SELECT category, '{{\"category\":' || to_json(category) || ',\"n_articles\":' || n_articles || ',\"n_located\":' || n_located || '}}' AS json FROM stats")
def category_json(spark: SparkSession, sf: str) -> DataFrame:
    """Categories with their counts as JSON."""
    s = category_stats.category_stats(_cats(spark, sf), _positions(spark, sf))
    return s.select("category", row_json("category", "n_articles", "n_located").alias("json"))


@_query("SELECT doc_id, CASE WHEN title IS NULL THEN 'null' ELSE '{' || to_json(title) || ':[' || coalesce(to_json(lang), 'null') || ',' || coalesce(to_json(source), 'null') || ']}' END AS json FROM documents")
def nested_json(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a title and a list as JSON."""
    pair = F.when(F.col("title").isNotNull(), F.struct(F.col("title").alias("a"), F.array("lang", "source").alias("b")))
    d = _docs(spark, sf).select("doc_id", pair.alias("pair"))
    return d.select("doc_id", value_json(F.col("pair"), d.schema["pair"].dataType).alias("json"))


@_query(f"""WITH {_KNN}, every AS (SELECT title FROM post UNION SELECT title FROM locs), id AS (SELECT title, row_number() OVER (ORDER BY title) - 1 AS id FROM every),
    got AS (SELECT near.title, x.id, rank FROM near JOIN id x ON x.title = near.neighbor WHERE rank <= 100)
    SELECT i.id, coalesce(string_agg(CAST(got.id AS VARCHAR), ',' ORDER BY rank), '') AS neighbors FROM id i LEFT JOIN got ON got.title = i.title GROUP BY i.id""")
def neighbor_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of each title's neighbours, as the neighbour sink writes them and reads them back."""
    locs = _locations(spark, sf)
    titles, _ = cut(_postings(spark, sf).select("title").unionByName(locs.select("title")).distinct(), "titles")
    path = write_neighbors(_near(spark, sf), titles, neighbors.dense_ids(titles, "title"), f"{scratch_dir(spark)}/sink-{uuid.uuid4().hex}", Weights())
    return spark.read.parquet(path).select("id", F.array_join(F.transform("neighbors", lambda n: n["id"].cast("string")), ",").alias("neighbors"))


@_query(f"WITH {_KNN}, w AS (SELECT title, neighbor AS entity, score AS weight FROM near WHERE rank <= 100), "
    "e AS (SELECT DISTINCT title, neighbor AS entity FROM neighbors WHERE title IS NOT NULL AND neighbor IS NOT NULL) "
    "SELECT e.title, e.entity, round(coalesce(weight, 0), 6) AS weight FROM e LEFT JOIN w ON w.title = e.title AND w.entity = e.entity")
def weights_assign(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "neighbors").where("title is not null and neighbor is not null").select("title", F.col("neighbor").alias("entity")).distinct()
    return weights.assign(e, weights.neighbor_weights(_near(spark, sf))).withColumn("weight", F.round("weight", 6))


@_query(f"WITH {_LOCS}, {_CATS}, t AS (SELECT title AS entity, max(len(category)) % 7 AS priority FROM cats GROUP BY title) "
    "SELECT s.title, s.location AS entity, round(score * CASE WHEN priority >= 5 AND ord < 20 THEN 2 ELSE 1 END * CASE WHEN priority >= 5 AND ord < 10 THEN 5 ELSE 1 END, 6) AS weight "
    "FROM shares s LEFT JOIN t ON t.entity = s.location")
def weights_boosted(spark: SparkSession, sf: str) -> DataFrame:
    locs = _locations(spark, sf)
    kinds = _cats(spark, sf).groupBy(F.col("title").alias("entity")).agg((F.max(F.length("category")) % 7).alias("priority"))
    told = lambda k: locs.where(F.col("ord") < k).select("title", F.col("location").alias("entity"))
    return weights.boosted(weights.location_weights(locs), kinds, told(20), told(10)).withColumn("weight", F.round("weight", 6))
