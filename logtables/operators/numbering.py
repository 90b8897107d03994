"""Consecutive numbers and trailing sums that no large group can stall."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.scratch import materialise

# Buckets per window task; at least the trailing span.
CHUNK = 4096


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys come from ``left``."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = functools.reduce(
        lambda a, b: a & b, (left[k].eqNullSafe(right[name]) for k, name in names.items())
    )
    return left.join(right, same, how).drop(*names.values())


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each ``by`` group, along ``order``.

    A row_number() would sort a whole group in one task. Here the rows are range
    partitioned on group and order together, so a group of any size spreads over
    many tasks; only the row counts per (group, partition) are summed up.
    ``by + order`` must identify a row. A null in ``by`` makes a group like any value.
    """
    keys = [*by, *order]
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns(
            {"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}
        ),
        "numbered",
    )
    runs = placed.groupBy(*by, "_part").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    number = F.col("_before") + F.col("_pos") - F.col("_first")
    return (
        join_on(placed, runs.drop("_rows"), [*by, "_part"])
        .withColumn(out, number.cast("bigint"))
        .drop("_part", "_pos", "_first", "_before")
    )


def trailing(
    counts: DataFrame, by: Sequence[str], index: str, start: int, end: int, sums: dict[str, Column]
) -> DataFrame:
    """Add sums over the rows whose ``index`` lies in ``[index+start, index+end]``.

    ``start <= end <= 0``. The index axis is cut into chunks; the last ``-start``
    positions of a chunk are also given to the next one, so each window task
    holds one chunk and its context, however long a series is.
    """
    size = max(CHUNK, -start)
    chunk = F.floor(F.col(index) / size).cast("bigint")
    near_end = F.pmod(F.col(index), F.lit(size)) >= size + start
    parts = F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = counts.withColumns({"_chunk": chunk, "_part": F.explode(parts)})
    window = Window.partitionBy(*by, "_part").orderBy(index).rangeBetween(start, end)
    totals = {name: F.sum(value).over(window) for name, value in sums.items()}
    return spread.withColumns(totals).filter("_part = _chunk").drop("_chunk", "_part")
