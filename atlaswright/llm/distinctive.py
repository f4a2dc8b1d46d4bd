"""How distinctive a term is per record: log-entropy weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_counts(article_words: DataFrame) -> DataFrame:
    """``record, term, tf``: lower-case terms; equal rows count once, other counts of a pair add up.

    Rows without title or word, with an empty word, or with ``tf`` null or below 1 do not count.
    """
    rows = article_words.where("title is not null and word is not null and word <> '' and tf >= 1")
    rows = rows.select(F.col("title").alias("record"), F.lower("word").alias("term"), F.col("tf").cast("long").alias("tf")).distinct()
    return rows.groupBy("record", "term").agg(F.sum("tf").alias("tf"))


def term_weights(counts: DataFrame) -> DataFrame:
    """``record, term, tf, df, global_weight, weight`` by log-entropy weighting.

    ``weight`` = log(1 + tf) * (1 - H / log N), H being the entropy of the term's occurrences over the
    records holding it and N the number of records: a term in one record keeps its full local weight,
    one spread evenly over all records gets 0. Two aggregations: the records are counted
    first; then each term's sums of tf and tf * log(tf) give its entropy, as
    H = log(S) - sum(tf * log tf) / S. Both combine before the shuffle, so a term of a third of all
    records costs no more than any other; its rows meet their weight in a join that adaptive execution splits.

    ``counts`` has one row for each record and term with tf >= 1. With fewer than two records every global weight is 1.
    The sum of tf * log(tf) is one of decimals, hence the same in any order of the rows: terms of equal counts get equal weights.
    """
    counts = counts.select("record", "term", "tf")
    n = counts.agg(F.count_distinct("record").cast("double").alias("n"))
    t = F.col("tf").cast("double")
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(t).alias("s"), F.sum((t * F.log(t)).cast("decimal(28,12)")).cast("double").alias("x"))
    entropy = F.log("s") - F.col("x") / F.col("s")
    glob = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - entropy / F.log(F.when(F.col("n") > 1, F.col("n"))))).otherwise(1.0)
    spread = spread.join(F.broadcast(n)).select("term", "df", glob.alias("global_weight"))  # n is one row
    return counts.join(spread, "term").select("record", "term", "tf", "df", "global_weight", (F.log1p("tf") * F.col("global_weight")).alias("weight"))


def leading_terms(weights: DataFrame, places: int = 9) -> DataFrame:
    """``record, term, weight``: the term of the greatest weight; weights equal to ``places`` places are a tie, which goes to the smaller term.

    Combines before the shuffle.
    """
    key = F.struct((-F.round("weight", places)).alias("w"), F.col("term"), F.col("weight").alias("weight"))
    return weights.groupBy("record").agg(F.min(key).alias("b")).select("record", F.col("b.term").alias("term"), F.col("b.weight").alias("weight"))
