"""Log files as lines: ``source, value, ingest_ts``."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _labelled(files: DataFrame, name: str | None, ingest_ts: Column | None) -> DataFrame:
    label = F.col("_metadata.file_name") if name is None else F.lit(name)
    # File time instead of read time: a line without a time of its own then keeps
    # its event id when the file is read again.
    time = F.col("_metadata.file_modification_time") if ingest_ts is None else ingest_ts
    # bytes that are not UTF-8 become the replacement character
    value = F.make_valid_utf8("value").alias("value")
    return files.select(label.alias("source"), value, time.alias("ingest_ts")).filter(
        F.col("value") != ""
    )


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    name: str | None = None,
    ingest_ts: Column | None = None,
    skip_bad_files: bool = False,
) -> DataFrame:
    """Every non-empty line of the files, labelled with the file's base name or ``name``.

    ``ingest_ts`` defaults to the file's modification time. ``skip_bad_files``
    reads on past files that vanish or cannot be read.
    """
    bad = str(skip_bad_files).lower()
    files = spark.read.options(ignoreMissingFiles=bad, ignoreCorruptFiles=bad).text(paths)
    return _labelled(files, name, ingest_ts)


def stream_logs(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    ingest_ts: Column | None = None,
    since: datetime | None = None,
    **options: str | int,
) -> DataFrame:
    """Lines of the files in ``path`` and of those that arrive later.

    Files last written before ``since`` are skipped; without it all are read.
    ``options`` go to the file source, e.g. ``maxFilesPerTrigger``.
    """
    files = spark.readStream.options(**options).text(path)
    if since is not None:
        files = files.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
    return _labelled(files, name, ingest_ts)


def merge_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of several labelled frames."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
