"""Structured Streaming: pages and documents that arrive in a folder, windowed counts and running term counts.

The batch operators need nothing of this; it is for feeding their inputs from a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.functions.text import tokens, without_stop_words
from atlaswright.sources.writers import exists


def stream_documents(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Documents of new Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """``start, key, n`` of events by tumbling window; events later than ``lateness`` are dropped by the watermark."""
    counted = events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def append_term_counts(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch's term counts; a batch that comes again replaces its own files, so nothing counts twice.

    Readers sum over batches: counts of distinct documents add up, as each document is in one batch.
    """
    counts = batch.select(F.explode(without_stop_words(tokens(F.col("text")))).alias("word"), "doc_id").groupBy("word").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("doc_id").alias("df"))
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def term_totals(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """``word, tf, df`` over the finished batches among those listed."""
    done = [f"{path}/batch={b}" for b in batches if exists(spark, f"{path}/batch={b}")]
    if not done:
        return spark.createDataFrame([], "word string, tf long, df long")
    return spark.read.parquet(*done).groupBy("word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
