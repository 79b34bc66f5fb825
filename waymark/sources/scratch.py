"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
_USED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of this machine serves if all executors run in
    this process (master local or local[...], as in tests); on a cluster it is an error."""
    global _OWN_DIR
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables go there")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="waymark-")
    return _OWN_DIR


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes with ``clear_scratch`` or at the driver's exit."""
    path = f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}"
    if path not in _USED:
        if not _USED:
            atexit.register(_clear_all)
        _USED[path] = spark
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, is evaluated once, and survives lost
    executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. DataFrames that read them can't be evaluated any more:
    call it when their results are written."""
    _delete(f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}", spark)


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark._jsc.sc().isStopped() else spark._jsc.hadoopConfiguration()).delete(where, True)
    _USED.pop(path, None)


def _clear_all() -> None:
    for path, spark in list(_USED.items()):
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001 - the driver is ending, and its JVM may have ended before
            pass
