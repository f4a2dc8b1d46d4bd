"""Writers: compute-once tables, rolling text files, JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlaswright.config import DEFAULTS, Weights


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table stands at ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written first where no complete one stands there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_rolling_text(lines: DataFrame, path: str, rows_per_file: int = DEFAULTS.rows_per_file) -> None:
    """Text files of at most ``rows_per_file`` records each."""
    lines.write.option("maxRecordsPerFile", rows_per_file).text(path)


def subcategory_line(counter: Column, category: Column, kids: Column) -> Column:
    """The tab-separated form that the reader of subcategory files takes."""
    return F.concat_ws("\t", counter.cast("string"), category, F.concat(F.lit("["), F.array_join(kids, "|||"), F.lit("]")))


def neighbors_path(folder: str, weights: Weights) -> str:
    """A path that names the weights a neighbour table was made with."""
    return f"{folder}/neighbors_{weights.words:.4f}_{weights.locations:.4f}_{weights.categories:.4f}"


def write_new(df: DataFrame, path: str) -> None:
    """Write a table; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def neighbor_lists(neighbors: DataFrame, titles: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, neighbors``: one row for each title, numbers for names, the most similar first; titles without neighbours have an empty list.

    ``neighbors``: title, neighbor, score, rank (few for each title). ``ids``: title, id. Scores are single-precision numbers.
    """
    named = neighbors.join(ids.select(F.col("title").alias("neighbor"), F.col("id").alias("n")), "neighbor")
    lists = named.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("n").alias("id"), F.col("score").cast("float").alias("score")))).alias("l"))
    kind = "array<struct<id: bigint, score: float>>"
    pairs = F.transform("l", lambda x: F.struct(x["id"].cast("bigint").alias("id"), x["score"].alias("score")))
    return titles.select("title").distinct().join(ids, "title").join(lists, "title", "left").select("id", F.coalesce(pairs, F.array().cast(kind)).alias("neighbors"))


def write_neighbors(neighbors: DataFrame, titles: DataFrame, ids: DataFrame, folder: str, weights: Weights) -> str:
    """Write the neighbour lists to a path that names the weights; an existing table there is an error. Returns the path."""
    path = neighbors_path(folder, weights)
    write_new(neighbor_lists(neighbors, titles, ids), path)
    return path


def vector_json(vector: Column) -> Column:
    """``array<struct<term, score>>`` as JSON, highest score first, ties by term."""
    by_score = F.array_sort(vector, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0))
    return F.to_json(by_score)


def value_json(value: Column, kind: T.DataType) -> Column:
    """Any column as JSON text: null, numbers, truth values, strings (escaped), pairs (structs of two fields), maps and arrays, nested at will.

    A pair is an object of one field that its first value names; a map's keys are read as strings. ``kind`` is the column's type.
    """
    if isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: value_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_key_json(e["key"]), F.lit(":"), value_json(e["value"], kind.valueType))
        body = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), entry), ","), F.lit("}"))
    elif isinstance(kind, T.StructType) and len(kind) == 2:
        a, b = kind.names
        body = F.concat(F.lit("{"), F.coalesce(_key_json(value[a]), F.lit('"null"')), F.lit(":"), value_json(value[b], kind[b].dataType), F.lit("}"))
    elif isinstance(kind, T.StringType):
        body = _key_json(value)
    else:
        body = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(body)


def _key_json(key: Column) -> Column:
    listed = F.to_json(F.array(key.cast("string")))
    return F.when(key.isNotNull(), F.substring(listed, 2, 1 << 30).substr(F.lit(1), F.length(listed) - 2))


def category_json() -> Column:
    """A category as JSON: its title, mean position, dispersion and counts."""
    return row_json("category", "lat", "lon", "dispersion", "n_articles", "n_located")


def row_json(*columns: str) -> Column:
    """The named columns as one JSON object."""
    return F.to_json(F.struct(*columns))
