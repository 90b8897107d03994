"""The event table: Parquet by event date, each event id once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtables.schema import EVENT_SCHEMA
from logtables.scratch import materialise, released


def dedup_events(events: DataFrame, order: Sequence[Column | str] = ("ingest_ts",)) -> DataFrame:
    """The first row of each event id along ``order``.

    Spark keeps one row per id and task before the shuffle, so many copies of one
    event cost little.
    """
    row = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    return events.withColumn("_row", row).filter("_row = 1").drop("_row")


def unseen(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose id is not stored yet."""
    return events.join(stored.select("event_id"), "event_id", "left_anti")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table; events without fields have an empty map."""
    events = spark.read.parquet(path)
    empty = F.create_map().cast("map<string,string>")
    return events.withColumn("fields", F.coalesce("fields", empty))


def count_events(events: DataFrame) -> DataFrame:
    """One row: the number of events."""
    return events.agg(F.count("*").alias("events"))


def _near(stored: DataFrame, events: DataFrame) -> DataFrame:
    """The stored events that can share an id with ``events``.

    An id fixes its event time to the millisecond, so only the dates of the batch and, of
    these, files and row groups within its span of time are read. The dates are as many as
    the days a batch touches, however many events it has.
    """
    milli = F.expr("interval 1 millisecond")
    span = events.agg(
        F.collect_set("event_date").alias("dates"),
        F.date_trunc("millisecond", F.min("ts")).alias("low"),
        (F.date_trunc("millisecond", F.max("ts")) + milli).alias("high"),
    )
    # as numbers, so that the zones of the session and of Python don't matter
    dates, low, high = span.select(
        "dates", F.unix_micros("low").alias("low"), F.unix_micros("high").alias("high")
    ).first()
    if not dates:
        return stored.filter(F.lit(False))
    return stored.filter(
        F.col("event_date").isin(dates)
        & (F.col("ts") >= F.timestamp_micros(F.lit(low)))
        & (F.col("ts") < F.timestamp_micros(F.lit(high)))
    )


@contextmanager
def _timestamps_with_statistics(spark: SparkSession) -> Iterator[None]:
    """Write times in the form of which Parquet keeps least and largest values."""
    key = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or no rows before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_events(events: DataFrame, path: str) -> None:
    """Append the events not stored yet; appending the same events again adds nothing.

    Rows are gathered by hour and sorted by time, so that a date gets few files, each of a
    short span of time; an hour with many events is split. What an append reads of the table
    depends on the span of its own events, not on how much their dates hold already.
    One writer at a time: two would not see each other's rows.
    """
    spark = events.sparkSession
    with released(spark):
        extra = [c for c in events.columns if c not in EVENT_SCHEMA.fieldNames()]
        # written out once, since both the dates and the rows are needed from it
        fresh = materialise(dedup_events(events), "append")
        try:
            stored = spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            fresh = unseen(fresh, _near(stored, fresh))
        fresh = (
            fresh.select(*EVENT_SCHEMA.fieldNames(), *extra)
            .withColumn("_hour", F.date_trunc("hour", "ts"))
            .hint("rebalance", "event_date", "_hour")
            .drop("_hour")
            .sortWithinPartitions("event_date", "ts")
        )
        with _timestamps_with_statistics(spark):
            fresh.write.mode("append").partitionBy("event_date").parquet(path)
