"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, object]] = []


def build_session(app: str = "atlaswright", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC times and adaptive execution; any setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, val in settings.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir`` where it is set.

    Only where neither that setting nor a checkpoint folder exists and all tasks run in this process (a local master: tests, one machine) a
    temporary folder is made and set for the session. On a cluster that would be another folder on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="atlaswright-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` once to the scratch folder and read it back: lineage ends at replicated files.

    Unlike a cached block, the table survives the loss of any executor. Returns the
    table and its path, which :func:`forget` removes. A table that nobody forgets is removed by a later call, once no plan reads it any
    more (its file index has been collected), or at the end of the program at the latest.
    """
    spark = df.sparkSession
    for owner, old, index in list(_written):
        if owner is spark and index is not None and index.get() is None:
            forget(spark, old)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, _index(table)))
    return table, path


def _index(table: DataFrame) -> object | None:
    """A weak reference to the file index that all plans made of a table share; none if its plan has another form."""
    try:
        index = table._jdf.queryExecution().analyzed().relation().location()
        return table.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(index)
    except Exception:  # noqa: BLE001 - then the table stays until the end of the program
        return None


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`cut`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path, _ in list(_written):
        try:
            forget(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
