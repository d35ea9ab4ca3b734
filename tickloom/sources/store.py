"""Intermediate tables in the shared folder of the session.

A result that several branches of a plan read is written once as parquet and
read back: the branches stay prunable, the lineage is cut, and losing an
executor does not lose the table. The folder is the one the session names in
``spark.checkpoint.dir``. A session that runs on a cluster must name one; a
local session without it gets a folder of its own. What was written is removed
when the driver ends.

``shared`` keeps a table for the session: the next query that needs the same
table over the same, unchanged files reads it instead of writing it again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_KEPT: dict[tuple, tuple[str, object]] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-store-", dir="/tmp")
    return _FALLBACK[app]


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of a table's files: what must be unchanged for a kept table to be used."""
    target, fs = _path(spark, source)
    files = fs.listStatus(target) if fs.exists(target) else []
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def stored_bytes(spark: SparkSession, source: str) -> int:
    """Size of a table's files."""
    return sum(length for _, length, _ in _state(spark, source))


def shared(spark: SparkSession, name: str, root: str, sources: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """The session's table ``name`` over ``root``, built from ``sources`` (paths) by ``build`` where it is not there yet."""
    key = (spark.sparkContext.applicationId, root, name, tuple(_state(spark, s) for s in sources))
    if key not in _KEPT:
        df = build()
        path = fresh_path(spark, name)
        df.write.parquet(path)
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                target, fs = _path(spark, path)
                fs.delete(target, True)
            except Exception:  # the session has ended; its folder goes with it
                break
