"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.llm.distinctive import leading_terms, term_weights, usable_counts
from atlaswright.llm.mixing import mix_sources
from atlaswright.llm.packing import container_report, pack_documents
from atlaswright.llm.rank_fusion import candidate_ranking
from atlaswright.llm.set_join import classes, expand, feature_rows, similar_sets
from atlaswright.llm.shared_spans import shared_lengths
from atlaswright.llm.top_n import kept_neighbors
from atlaswright.plans.core_queries import _reading, table


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return similar_sets(feature_rows(table(spark, sf_dir, "categories"), table(spark, sf_dir, "named_locations")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles whose categories, or named locations, largely agree."""
    return expand(*_sets(spark, sf_dir)).select(F.col("part").alias("feature"), F.col("record_a").alias("title_a"), F.col("record_b").alias("title_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title with the class of its set and its number of similar titles."""
    return classes(*_sets(spark, sf_dir)).select(F.col("part").alias("feature"), F.col("record").alias("title"), F.col("class").alias("set_class"), "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that ranks first for each title."""
    return candidate_ranking(table(spark, sf_dir, "neighbor_scores"), keep=1).select("title", "neighbor")


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of each title."""
    return candidate_ranking(table(spark, sf_dir, "neighbor_scores")).withColumn("fused", F.round("fused", 9))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weights(usable_counts(table(spark, sf_dir, "article_words")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most distinctive word of each title."""
    return leading_terms(_weights(spark, sf_dir)).select(F.col("record").alias("title"), F.col("term").alias("word"))


def p3_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every word of every title."""
    return _weights(spark, sf_dir).select(F.col("record").alias("title"), F.col("term").alias("word"), "tf", "df", F.round("weight", 6).alias("weight"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of each title."""
    return kept_neighbors(table(spark, sf_dir, "neighbors")).select("title", "neighbor")


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best neighbours of each title with score and rank."""
    return kept_neighbors(table(spark, sf_dir, "neighbors"), 100)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too long for one container."""
    return pack_documents(table(spark, sf_dir, "documents")).where("is_split and part = 0").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in each container."""
    return pack_documents(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return container_report(pack_documents(table(spark, sf_dir, "documents")))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, chars, in_order, fits``: characters of each text in containers; whether its parts follow each other without gap, in containers not overfull."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    by = packed.join(full, "container").groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).alias("chars"), F.max("end").alias("last"), F.min("start").alias("first"), F.max("fill").alias("fill"), F.max("part").alias("p"), F.count(F.lit(1)).alias("n")
    )
    return by.select("doc_id", "chars", ((F.col("first") == 0) & (F.col("last") == F.col("chars")) & (F.col("p") == F.col("n") - 1)).alias("in_order"), (F.col("fill") <= 2048).alias("fits"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share: all their blocks are drawn as often as allowed, and the draw still falls short."""
    report = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).report
    return report.where("exhausted and drawn_tokens < target_tokens").select("source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and drawn shares of each source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).report


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).drawn


def p9_limits(spark: SparkSession, sf_dir: str, block: int = 2048) -> DataFrame:
    """What holds of every draw, by source: tokens within half a block of the target or all used up, and no token drawn too often.

    ``most_uses`` is the greatest number of times that any token of the source is drawn, if it is more than allowed, else the allowed one.
    """
    mix = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), block)
    uses = mix.drawn.groupBy("source", "doc_id", "from_token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("use").alias("u")).groupBy("source").agg(F.max(F.greatest("n", "u")).alias("n"))
    r = mix.report.join(uses, "source", "left")
    near = F.abs(F.col("drawn_tokens") - F.col("target_tokens")) <= block / 2
    return r.select("source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), (near | F.col("exhausted")).alias("on_target"), F.greatest(F.coalesce("n", F.lit(0)), "max_repeats").cast("int").alias("most_uses"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each document stand elsewhere, too."""
    return shared_lengths(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and shared part of every document."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    both = sizes.join(shared_lengths(docs), "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return both.withColumn("shared_part", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).otherwise(0.0))


def queries() -> dict:
    fs = (p1_found, p1_classes, p2_found, p2_ranking, p3_found, p3_weights, p6_found, p6_ranked, p8_found, p8_containers, p8_coverage, p8_report, p9_found, p9_report, p9_limits, p9_drawn, p10_found, p10_shares)
    return {f.__name__: f for f in fs}


_SETS = f"""
vals AS (
  SELECT DISTINCT 'categories' AS feature, title, {_reading("category")} AS v FROM categories WHERE title IS NOT NULL
  UNION SELECT DISTINCT 'named_locations', title, nullif(regexp_replace(regexp_replace(location, '^[\\s_]+|[\\s_]+$', '', 'g'), '\\s', '_', 'g'), '')
  FROM named_locations WHERE title IS NOT NULL AND cnt >= 1),
held AS (SELECT feature, title, v, count(*) OVER (PARTITION BY feature, title) AS n FROM vals WHERE v IS NOT NULL),
common AS (
  SELECT a.feature, a.title AS title_a, b.title AS title_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM held a JOIN held b ON a.feature = b.feature AND a.v = b.v AND a.title < b.title
  WHERE a.n >= 3 AND b.n >= 3 GROUP BY ALL),
pairs AS (SELECT feature, title_a, title_b FROM common WHERE 5 * c >= 3 * (na + nb - c))
"""

_WORDS = """
counts AS (
  SELECT title, word, sum(tf) AS tf FROM (
    SELECT DISTINCT title, lower(word) AS word, tf FROM article_words WHERE title IS NOT NULL AND word IS NOT NULL AND word <> '' AND tf >= 1)
  GROUP BY title, word),
n AS (SELECT count(DISTINCT title) AS n FROM counts),
spread AS (SELECT word, count(*) AS df, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS h FROM counts GROUP BY word),
weights AS (
  SELECT title, c.word, CAST(tf AS BIGINT) AS tf, df, ln(1 + tf) * greatest(0, 1 - h / ln(n)) AS weight
  FROM counts c JOIN spread s ON s.word = c.word, n)
"""

_BEST = """
once AS (
  SELECT title, neighbor, max(score) AS score FROM neighbors
  WHERE title IS NOT NULL AND neighbor IS NOT NULL AND title <> neighbor AND score >= 0.1 AND NOT isnan(score) GROUP BY title, neighbor),
ranked AS (SELECT title, neighbor, score, row_number() OVER (PARTITION BY title ORDER BY score DESC, neighbor) AS rank FROM once)
"""


_FUSED = """
base AS (
  SELECT DISTINCT title, neighbor, CASE WHEN isnan(tf_idf) THEN NULL ELSE tf_idf END AS x0, CASE WHEN isnan(named_locations) THEN NULL ELSE named_locations END AS x1,
    CASE WHEN isnan(categories) THEN NULL ELSE categories END AS x2 FROM neighbor_scores WHERE title IS NOT NULL AND neighbor IS NOT NULL AND title <> neighbor),
long AS (SELECT title, unnest([0, 1, 2]) AS k, unnest([x0, x1, x2]) AS v FROM base),
med AS (SELECT title, k, median(v) AS m FROM long WHERE v IS NOT NULL GROUP BY title, k),
dev AS (SELECT l.title, l.k, any_value(m) AS m, median(abs(v - m)) AS mad, avg(abs(v - m)) AS mean FROM long l JOIN med ON med.title = l.title AND med.k = l.k WHERE v IS NOT NULL GROUP BY l.title, l.k),
scale AS (SELECT title, k, m, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN mean > 0 THEN mean * 1.2533 END AS s FROM dev),
wide AS (SELECT title, max(m) FILTER (k = 0) AS m0, max(m) FILTER (k = 1) AS m1, max(m) FILTER (k = 2) AS m2, max(s) FILTER (k = 0) AS s0, max(s) FILTER (k = 1) AS s1, max(s) FILTER (k = 2) AS s2 FROM scale GROUP BY title),
z AS (SELECT b.title, neighbor, """ + ", ".join(f"x{k} IS NULL AS n{k}, least(600, greatest(-600, coalesce((x{k} - m{k}) / nullif(s{k}, 0), 0))) AS z{k}" for k in range(3)) + """
  FROM base b LEFT JOIN wide w ON w.title = b.title),
f AS (SELECT title, neighbor, (""" + " + ".join(f"CASE WHEN n{k} THEN -700 WHEN z{k} > -30 THEN -ln(1 + exp(-z{k})) ELSE z{k} END" for k in range(3)) + """) / 3 AS fused,
  (""" + " + ".join(f"CASE WHEN n{k} THEN -700 ELSE z{k} END" for k in range(3)) + """) / 3 AS plain FROM z),
one AS (SELECT title, neighbor, max(fused) AS fused, max_by(plain, fused) AS plain FROM f GROUP BY title, neighbor)
"""

_WINDOWS = """
w AS (SELECT doc_id, i, substr(text, CAST(i + 1 AS INT), 150) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
twice AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN twice ON twice.s = w.s)
"""


# the pieces a byte-level tokenizer starts from; the answers are the same for all usual tokenizers, hence for this plainest one
_PIECES = r"len(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_classes": f"""WITH {_SETS},
            sets AS (SELECT feature, title, list(v ORDER BY v) AS s FROM held WHERE n >= 3 GROUP BY feature, title),
            linked AS (SELECT feature, t, count(*) AS c FROM (SELECT feature, title_a AS t FROM pairs UNION ALL SELECT feature, title_b FROM pairs) GROUP BY feature, t)
            SELECT s.feature, title, min(title) OVER (PARTITION BY s.feature, s) AS set_class, coalesce(c, 0) AS links FROM sets s LEFT JOIN linked l ON l.feature = s.feature AND l.t = title""",
        "p2_found": f"WITH {_FUSED} SELECT title, neighbor FROM one QUALIFY row_number() OVER (PARTITION BY title ORDER BY round(fused, 12) DESC, plain DESC, neighbor) = 1",
        "p2_ranking": f"WITH {_FUSED} SELECT title, neighbor, round(fused, 9) AS fused, row_number() OVER (PARTITION BY title ORDER BY round(fused, 12) DESC, round(plain, 12) DESC, neighbor) AS rank FROM one",
        "p10_shares": f"""WITH {_WINDOWS}, got AS (SELECT doc_id, CAST(sum(least(150, coalesce(i - p, 150))) AS BIGINT) AS c FROM hit GROUP BY doc_id)
            SELECT d.doc_id, coalesce(length(text), 0) AS chars, coalesce(c, 0) AS shared_chars,
              CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(c, 0) / length(text), 6) ELSE 0 END AS shared_part FROM documents d LEFT JOIN got ON got.doc_id = d.doc_id""",
        "p10_found": f"WITH {_WINDOWS} SELECT doc_id, CAST(sum(least(150, coalesce(i - p, 150))) AS BIGINT) AS shared_chars FROM hit GROUP BY doc_id",
        "p8_found": f"SELECT doc_id FROM documents WHERE {_PIECES} > 2048",
        "p9_found": f"""WITH n AS (SELECT lower(trim(source)) AS source, sum({_PIECES}) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1),
            t AS (SELECT s.*, coalesce(n, 0) AS n FROM source_targets s LEFT JOIN n ON n.source = s.source) SELECT source FROM t WHERE n * max_repeats < target_share * (SELECT sum(n) FROM t)""",
        "p8_coverage": "SELECT doc_id, length(text) AS chars, TRUE AS in_order, TRUE AS fits FROM documents WHERE length(text) > 0",
        "p9_limits": "SELECT source, target_share, max_repeats, TRUE AS on_target, max_repeats AS most_uses FROM source_targets",
        "p1_found": f"WITH {_SETS} SELECT feature, title_a, title_b FROM pairs",
        "p3_found": f"WITH {_WORDS} SELECT title, word FROM weights QUALIFY row_number() OVER (PARTITION BY title ORDER BY round(weight, 9) DESC, word) = 1",
        "p3_weights": f"WITH {_WORDS} SELECT title, word, tf, df, round(weight, 6) AS weight FROM weights",
        "p6_found": f"WITH {_BEST} SELECT title, neighbor FROM ranked WHERE rank <= 10",
        "p6_ranked": f"WITH {_BEST} SELECT title, neighbor, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 100",
    }
