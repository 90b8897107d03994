"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go at the end of the query that wrote them, not when the driver next
#: collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_held = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete what :func:`materialise` wrote inside, once the block is left.

    For work whose result is stored elsewhere by then, such as a micro-batch. What is written
    with the function that the block is given stays, as if written outside.
    """
    before = getattr(_held, "paths", None)
    _held.paths = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        if before is not None:
            before.append(path)
        return _written(df, path)

    try:
        yield kept
    finally:
        paths, _held.paths = _held.paths, before
        for path in paths:
            _delete(spark, path)


def forget(df: DataFrame) -> None:
    """Delete the table behind ``df`` if :func:`materialise` wrote it; for a table that nothing
    reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    The setting must name storage all executors share. Only a local session may
    leave it unset; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="logtables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/logtables/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if getattr(_held, "paths", None) is not None:
        _held.paths.append(path)
    return _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
