"""Joins on keys of which some hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, most: int = 20_000) -> DataFrame:
    """Inner join on ``keys`` in which no task gets more than about ``most`` rows of one key from the left.

    Keys with more rows on the left are split into as many salts as needed, by a hash of ``spread_by``; only those keys' rows are
    repeated on the right, once for each salt. There are at most (left rows / ``most``) such keys. Null keys do not join.

    Both sides are spread over as many tasks as the session's shuffles have (at least one a core): such joins give far more rows than
    they take, and adaptive execution, which goes by the small input, would put them into a few tasks.
    """
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > most)
    hot = hot.select(*keys, F.ceil(F.col("__c") / most).alias("__n"))
    salt = F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64(spread_by), F.col("__n"))).otherwise(F.lit(0))
    salted = left.join(hot, keys, "left").withColumn("__salt", salt.cast("long")).drop("__n")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("__n", F.lit(1)) - 1)
    spread = right.join(hot, keys, "left").withColumn("__salt", F.explode(salts)).drop("__n")
    on = [*keys, "__salt"]
    return salted.repartition(parts, *on).join(spread.repartition(parts, *on).hint("merge"), on).drop("__salt")
