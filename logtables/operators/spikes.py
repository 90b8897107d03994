"""Events per time bucket, and buckets far above their recent past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.functions.times import bucket_start
from logtables.operators.numbering import join_on, trailing
from logtables.scratch import materialise


def bucket_counts(
    events: DataFrame, by: Sequence[str] = (), bucket_seconds: int = 10, time: str = "ts"
) -> DataFrame:
    """``by..., start_ms, count`` of the buckets that hold events."""
    return events.groupBy(
        *by, bucket_start(F.col(time), bucket_seconds).alias("start_ms")
    ).agg(F.count("*").alias("count"))


def series_span(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """First and last bucket of each series."""
    return counts.groupBy(*by).agg(
        F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms")
    )


def score_buckets(
    counts: DataFrame,
    by: Sequence[str],
    bucket_seconds: int = 10,
    window: int = 30,
    k: float = 3.0,
    min_count: int = 5,
) -> DataFrame:
    """Add the z-score of each bucket against the ``window`` buckets before it.

    ``counts`` carries ``first_ms``, the first bucket of its series. Buckets
    without events are not rows, yet count as zero: they add nothing to the sums,
    and the number of buckets follows from the distance to the first one.
    """
    bucket_ms = bucket_seconds * 1000
    index = F.expr(f"start_ms div {bucket_ms}")
    n = F.least(F.lit(window), F.expr(f"(start_ms - first_ms) div {bucket_ms}"))
    value = F.col("count").cast("double")
    scored = trailing(
        counts.withColumns({"_index": index, "_n": n}),
        by,
        "_index",
        -window,
        -1,
        {"_s1": value, "_s2": value * value},
    )
    mean = F.when(F.col("_n") > 0, F.coalesce("_s1", F.lit(0.0)) / F.col("_n")).otherwise(0.0)
    square = F.when(F.col("_n") > 0, F.coalesce("_s2", F.lit(0.0)) / F.col("_n")).otherwise(0.0)
    scored = scored.withColumn("mean", mean)
    variance = F.greatest(F.lit(0.0), square - F.col("mean") * F.col("mean"))
    scored = scored.withColumn("stddev", F.sqrt(variance))
    above = F.col("count") - F.col("mean")
    z = (
        F.when(F.col("_n") < 2, 0.0)
        .when(F.col("stddev") > 0, above / F.nullif(F.col("stddev"), F.lit(0.0)))
        .when(above > 0, F.lit(float("inf")))
        .otherwise(0.0)
    )
    scored = scored.withColumn("z_score", z)
    spike = (F.col("_n") >= 2) & (F.col("count") >= min_count) & (F.col("z_score") >= k)
    return scored.withColumn("is_anomaly", spike).drop("_index", "_n", "_s1", "_s2")


def _with_span(counts: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Counts with the span of their series; a lone series gets a constant key.

    The counts are written once: both sides of the join are read from them, so the
    events are read and parsed once. A null key is a series like any other.
    """
    keys = by or ["_series"]
    if not by:
        counts = counts.withColumn("_series", F.lit(0))
    counts = materialise(counts, "bucket_counts")
    return join_on(counts, series_span(counts, keys), keys), keys


def spikes(
    events: DataFrame,
    by: Sequence[str] = (),
    bucket_seconds: int = 10,
    window: int = 30,
    k: float = 3.0,
    min_count: int = 5,
    include_open: bool = False,
) -> DataFrame:
    """Scored buckets of each series; its newest, still open bucket only on request."""
    counts, keys = _with_span(bucket_counts(events, by, bucket_seconds), list(by))
    scored = score_buckets(counts, keys, bucket_seconds, window, k, min_count)
    if not include_open:
        scored = scored.filter("start_ms < last_ms")
    return scored.select(
        *by, "start_ms", "count", "mean", "stddev", "z_score", "is_anomaly"
    )


def recent_counts(
    events: DataFrame, by: Sequence[str] = (), bucket_seconds: int = 10, window: int = 30
) -> DataFrame:
    """``counts`` of the last ``window`` completed buckets, empty ones as 0, oldest first."""
    step = bucket_seconds * 1000
    counts, keys = _with_span(bucket_counts(events, by, bucket_seconds), list(by))
    start = F.greatest(F.col("first_ms"), F.col("last_ms") - window * step)
    found = F.map_from_entries(
        F.collect_list(
            F.when(
                (F.col("start_ms") < F.col("last_ms")), F.struct("start_ms", "count")
            )
        )
    )
    starts = F.when(
        F.col("from_ms") < F.col("last_ms"),
        F.sequence("from_ms", F.col("last_ms") - step, F.lit(step).cast("bigint")),
    ).otherwise(F.array().cast("array<bigint>"))
    filled = F.transform(
        starts, lambda s: F.coalesce(F.try_element_at("_found", s), F.lit(0).cast("bigint"))
    )
    return (
        counts.withColumn("from_ms", start)
        .filter("start_ms >= from_ms")
        .groupBy(*keys, "from_ms", "last_ms")
        .agg(found.alias("_found"))
        .select(*by, filled.alias("counts"))
    )
