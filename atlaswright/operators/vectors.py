"""Dictionaries, tf-idf vectors and location vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.config import DEFAULTS
from atlaswright.functions.readings import location_reading


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """``title, word, tf`` from ``title, words``; null titles and empty arrays give nothing."""
    return tokens.where("title is not null").select("title", F.explode("words").alias("word")).groupBy("title", "word").agg(F.count(F.lit(1)).alias("tf"))


def clean_counts(article_words: DataFrame) -> DataFrame:
    """Counted words of a table, in lower case; equal rows count once, unusable ones (null or below 1) not at all."""
    ok = article_words.where("title is not null and word is not null and word <> '' and tf >= 1")
    return ok.select("title", F.lower("word").alias("word"), F.col("tf").cast("long").alias("tf")).distinct().groupBy("title", "word").agg(F.sum("tf").alias("tf"))


def dictionary(counts: DataFrame) -> DataFrame:
    """``word, df``: in how many titles each word occurs."""
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def corpus_totals(counts: DataFrame) -> DataFrame:
    """One row: ``n_docs, n_words``."""
    return counts.agg(F.count_distinct("title").alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_words"))


def idf(counts: DataFrame) -> DataFrame:
    """``word, df, idf`` with idf = log10(N / df)."""
    n = corpus_totals(counts).select("n_docs")
    return dictionary(counts).join(F.broadcast(n)).select("word", "df", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))  # n is one row


def _top_normal(scored: DataFrame, key: str, top: int, *ties: str) -> DataFrame:
    best = Window.partitionBy("title").orderBy(F.desc("score"), *ties)
    kept = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    norm = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("title")))
    return kept.select("title", key, F.when(norm > 0, F.col("score") / norm).otherwise(0.0).alias("score"))


def word_vectors(counts: DataFrame, top: int = DEFAULTS.top_words) -> DataFrame:
    """``title, word, score``: log10(1 + tf) * idf, the ``top`` best of a title (ties by word) at length 1.

    A title whose words all have idf 0 keeps zero scores.
    """
    scored = counts.join(idf(counts), "word").select("title", "word", (F.log10(1 + F.col("tf")) * F.col("idf")).alias("score"))
    return _top_normal(scored, "word", top, "word")


def usable_locations(named_locations: DataFrame, last_word: int | None = DEFAULTS.last_location_word) -> DataFrame:
    """``title, location, cnt, ord`` by the locations' readings: counts add up, the first mention counts.

    Equal rows count once; rows without title or location, with a count below 1 or first named after word ``last_word``, do not.
    """
    rows = named_locations.select("title", location_reading(F.col("location")).alias("location"), F.col("cnt").cast("long").alias("cnt"), "ord").distinct()
    rows = rows.where("title is not null and location is not null and cnt >= 1")
    if last_word is not None:
        rows = rows.where((F.col("ord") <= last_word) & (F.col("ord") >= 0))
    return rows.groupBy("title", "location").agg(F.sum("cnt").alias("cnt"), F.min("ord").alias("ord"))


def location_vectors(locations: DataFrame, top: int = DEFAULTS.top_locations) -> DataFrame:
    """``title, location, score``: square root of a location's share of all mentions, the ``top`` best at length 1; ties by first mention, then by location."""
    share = F.sqrt(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("title")))
    return _top_normal(locations.withColumn("score", share), "location", top, "ord", "location").select("title", "location", "score")


def dense_cosines(rows: DataFrame, least: float = DEFAULTS.least_similarity, blocks: int = 16) -> DataFrame:
    """``id_a, id_b, cosine`` of ``id, vector``: every pair of vectors with a cosine of at least ``least`` (at six places), ``id_a < id_b``.

    All vectors meet all others, block by block; each row is sent ``blocks`` times. Ids are distinct. Null ids, and vectors that are null, empty,
    of length 0 or hold a null or a value that is no number, have no cosine; vectors of unlike sizes do not meet.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = rows.where("id is not null and vector is not null").select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    v = v.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own"))
    left = v.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1).cast("long"))).alias("j"), F.col("id").alias("a"), "v")
    right = v.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("v").alias("w"))
    met = left.join(right, ["i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & (F.size("v") == F.size("w")))
    met = met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), dot(F.col("v"), F.col("w")).alias("cosine"))
    return met.where(F.round("cosine", 6) >= least)
