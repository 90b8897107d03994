"""Ingest rate, lag percentiles, totals, and the one-row status."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.functions.times import ingest_lag_ms
from logtables.operators.numbering import trailing


def _second(time: Column) -> Column:
    return F.unix_seconds(time)


def rate_per_second(
    events: DataFrame, window_s: int = 5, by: Sequence[str] = (), time: str = "ingest_ts"
) -> DataFrame:
    """Sliding rate at every second with events: the last ``window_s`` seconds' mean."""
    keys = list(by) or ["_series"]
    events = events if by else events.withColumn("_series", F.lit(0))
    counts = events.groupBy(*keys, _second(F.col(time)).alias("second")).agg(
        F.count("*").alias("count")
    )
    summed = trailing(counts, keys, "second", 1 - window_s, 0, {"_sum": F.col("count")})
    return summed.select(*by, "second", "count", (F.col("_sum") / window_s).alias("rate"))


def _in_window(time: str, now: Column, window_s: int) -> Column:
    """True in the last ``window_s`` whole seconds up to and including that of ``now``."""
    upto = F.timestamp_seconds(_second(now) + 1)
    start = F.timestamp_seconds(_second(now) + 1 - window_s)
    return (F.col(time) >= start) & (F.col(time) < upto)


def _as_time(now: Column | datetime | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def ingest_rate(
    events: DataFrame,
    now: Column | datetime | None = None,
    window_s: int = 5,
    time: str = "ingest_ts",
) -> DataFrame:
    """One row: events per second over the last ``window_s`` seconds."""
    live = events.filter(_in_window(time, _as_time(now), window_s))
    return live.agg((F.count("*") / window_s).alias("rate"))


def latest(df: DataFrame, order: Sequence[Column | str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows along ``order``, per group if ``by`` is given.

    The first ``n`` rows of a group are among the first ``n`` of each of its parts,
    so a group is cut in as many parts as a shuffle has before it comes together.
    """
    if not by:
        return df.orderBy(*order).limit(n)

    def cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_row", row).filter(F.col("_row") <= n).drop("_row")

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    part = F.pmod(F.xxhash64(*plain), F.lit(parts))
    return cut(cut(df.withColumn("_part", part), [*by, "_part"]).drop("_part"), by)


def percentiles(observations: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ``p50``, ``p95`` with linear interpolation, 0 if there are no rows.

    Meant for samples cut by :func:`latest`; the exact percentile holds a group's
    distinct values.
    """
    both = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return (
        observations.groupBy(*by)
        .agg(both.alias("_p"))
        .select(
            *by,
            F.coalesce(F.get("_p", F.lit(0)), F.lit(0.0)).alias("p50"),
            F.coalesce(F.get("_p", F.lit(1)), F.lit(0.0)).alias("p95"),
        )
    )


def lag_percentiles(events: DataFrame, sample: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of the ingest lag over the latest ``sample`` events."""
    lags = events.select(
        *by, "ingest_ts", "event_id", ingest_lag_ms(F.col("ts"), F.col("ingest_ts")).alias("lag_ms")
    )
    return percentiles(latest(lags, [F.desc("ingest_ts"), "event_id"], sample, by), "lag_ms", by)


def health_snapshot(
    events: DataFrame,
    clusters: DataFrame,
    now: Column | datetime | None = None,
    window_s: int = 5,
    latencies: DataFrame | None = None,
) -> DataFrame:
    """One row: totals, rate, latest lag, cluster count, p50 and p95 of ``latency_ms``.

    ``clusters`` has one row per template; ``latencies`` a column ``latency_ms``,
    already cut to the sample wanted. Without it both percentiles are 0.
    """
    live = _in_window("ingest_ts", _as_time(now), window_s)
    lag = ingest_lag_ms(F.col("ts"), F.col("ingest_ts"))
    totals = events.agg(
        F.count("*").alias("events_total"),
        F.bround(F.count_if(live) / window_s, 1).alias("ingest_per_s"),
        F.coalesce(F.max_by(lag, F.struct("ingest_ts", "event_id")), F.lit(0.0))
        .cast("bigint")
        .alias("ingest_lag_ms"),
    )
    if latencies is None:
        latencies = events.sparkSession.createDataFrame([], "latency_ms double")
    tails = percentiles(latencies, "latency_ms").select(
        F.bround("p50", 1).alias("query_p50_ms"), F.bround("p95", 1).alias("query_p95_ms")
    )
    # three one-row frames, put side by side on a constant key
    one = [
        f.withColumn("_one", F.lit(1))
        for f in (totals, clusters.agg(F.count("*").alias("clusters")), tails)
    ]
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")


# The form of the status line, and of its part for kept summaries.
STATUS = "in %s/s  |  q %d  |  lag %dms  |  clusters %d  |  total %d"
STATUS_HITS = "  |  ai-cache %d%%"


def status_line(
    snapshot: DataFrame, queue_depth: int = 0, hit_rate: Column | float | None = None
) -> DataFrame:
    """The snapshot as one line of text."""
    values = [F.col("ingest_per_s").cast("string"), F.lit(queue_depth), "ingest_lag_ms"]
    values += ["clusters", "events_total"]
    shape = STATUS
    if hit_rate is not None:
        rate = hit_rate if isinstance(hit_rate, Column) else F.lit(hit_rate)
        shape += STATUS_HITS
        values.append((rate * 100).cast("int"))
    return snapshot.withColumn("status", F.format_string(shape, *values))
