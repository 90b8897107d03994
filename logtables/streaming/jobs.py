"""Streaming jobs: keep events, count buckets, score spikes, tag templates.

Each takes a streaming frame of events, a table path and a checkpoint, and returns
the running query. Input rate is set on the source (``maxFilesPerTrigger``,
``maxBytesPerTrigger``), pace by ``trigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtables.operators import templates as T
from logtables.operators.numbering import numbered
from logtables.scratch import materialise, released
from logtables.sources.store import append_events
from logtables.streaming.series import PROVIDER, ROCKS_DB, score_series
from logtables.streaming.tables import StateTable, write_batch

PARTS = "spark.sql.shuffle.partitions"

# How far events may come behind the latest event time seen.
DELAY = "10 minutes"


def _each_batch(
    stream: DataFrame,
    checkpoint: str,
    work: Callable[[DataFrame, int], None],
    trigger: dict | None,
    mode: str = "append",
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(work).start()


def dedup_stream(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events whose id was not seen within the last ``delay`` of event time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def keep_events(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append to the event table, each id once, also over restarts and resent files."""

    def append(batch: DataFrame, _: int) -> None:
        append_events(batch, path)

    return _each_batch(events, checkpoint, append, trigger)


def closed_buckets(
    events: DataFrame, by: Sequence[str] = (), bucket_seconds: int = 10, delay: str = DELAY
) -> DataFrame:
    """``by..., start_ms, count`` of each bucket, once, when no more events can join it.

    Events later than ``delay`` are dropped; earlier ones count in their bucket.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{bucket_seconds} seconds").alias("_w"), *by)
        .agg(F.count("*").alias("count"))
        .select(*by, F.unix_millis("_w.start").alias("start_ms"), "count")
    )


def sliding_rate(
    events: DataFrame, window_s: int = 5, time: str = "ingest_ts", delay: str = DELAY
) -> DataFrame:
    """``second, rate``: events per second over the ``window_s`` seconds ending with it."""
    window = F.window(time, f"{window_s} seconds", "1 second").alias("_w")
    return (
        events.withWatermark(time, delay)
        .groupBy(window)
        .agg((F.count("*") / window_s).alias("rate"))
        .select((F.unix_seconds("_w.end") - 1).alias("second"), "rate")
    )


def watch_spikes(
    events: DataFrame,
    path: str,
    checkpoint: str,
    by: Sequence[str] = (),
    bucket_seconds: int = 10,
    window: int = 30,
    k: float = 3.0,
    min_count: int = 5,
    delay: str = DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score every bucket as it closes, into the table ``path/scored``.

    The state is the open buckets and the last ``window`` closed ones of each series; a batch
    reads nothing else, however long the stream has run. It is dealt into as many parts as
    there are cores (or ``spark.sql.shuffle.partitions``, if less): every batch opens the
    state of every part, twice, so more of them cost time without giving work.
    """
    buckets = closed_buckets(events, by, bucket_seconds, delay)
    scored = score_series(buckets, by, bucket_seconds, window, k, min_count)
    writer = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    conf = events.sparkSession.conf
    parts = min(int(conf.get(PARTS)), events.sparkSession.sparkContext.defaultParallelism)
    settings = {PROVIDER: ROCKS_DB, PARTS: str(parts)}
    before = {key: conf.get(key) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)  # a query keeps the settings of its start
    try:
        return writer.format("parquet").start(f"{path}/scored")
    finally:
        for key, value in before.items():
            conf.set(key, value)


_CHILDREN = "level int, leaf string, token string"
_IDS = "leaf string, template_no int, template_id bigint"


def tag_batch(
    batch: DataFrame,
    number: int,
    path: str,
    message: str = "message",
    order: str = "ts",
    depth: int = T.DEPTH,
    sim_threshold: float = T.SIM_THRESHOLD,
    max_children: int = T.MAX_CHILDREN,
    chunk: int = T.REPLAY_CHUNK,
    store: str | None = None,
) -> None:
    """Go on mining with one micro-batch and write its events with their template.

    State tables: ``children`` keeps the tokens each node has taken, ``book`` the templates
    of each leaf, ``ids`` the numbers given out, ``given`` how many. Their size follows the
    templates, and what a batch reads of them doesn't grow with the batches before.
    ``events`` is the result with ``template_id`` and ``template_key``. With ``store``, the
    result goes to the event table of that path instead, each id once. What the batch wrote
    on the way is deleted.
    """
    with released(batch.sparkSession):
        tagged = _tag(batch, number, path, message, order, depth, sim_threshold, max_children, chunk)
        if store:
            append_events(tagged, store)
        else:
            write_batch(tagged, f"{path}/events", number)


def _tag(
    batch: DataFrame,
    number: int,
    path: str,
    message: str,
    order: str,
    depth: int,
    sim_threshold: float,
    max_children: int,
    chunk: int,
) -> DataFrame:
    spark = batch.sparkSession
    events = materialise(batch, "events")
    children = StateTable(spark, f"{path}/children", _CHILDREN)
    books = StateTable(spark, f"{path}/book", T.BOOK_SCHEMA, ["leaf"])
    ids = StateTable(spark, f"{path}/ids", _IDS)
    given = StateTable(spark, f"{path}/given", "given bigint, one int", ["one"])

    patterns = materialise(T.pattern_counts(events, message, order, number), "patterns")
    keyed, kept = T.leaf_keys(patterns, depth, max_children, children.read(number).drop("batch"))
    keyed = materialise(keyed, "keyed")
    children.write(kept, number)

    book = T.mine_book(keyed, books.read(number).drop("batch"), sim_threshold, chunk)
    book = materialise(book, "book")
    books.write(book, number)

    at = F.get("steps", F.lit(0))
    made = book.withColumn("at", at).filter(F.col("at.epoch") == number)
    made = numbered(made.select("leaf", "template_no", "at"), [], ["at"], "_n")
    before = given.read(number).first()
    before = before["given"] if before else 0
    new_ids = made.select("leaf", "template_no", (F.col("_n") + before).alias("template_id"))
    new_ids = materialise(new_ids, "ids")
    ids.write(new_ids, number)
    total = spark.range(1).select(F.lit(before + new_ids.count()).alias("given"), F.lit(1).alias("one"))
    given.write(total, number)
    known = ids.read(number).drop("batch").unionByName(new_ids)

    home = ["leaf", "template_no"]
    named = book.select(*home, T.template_key(F.col("leaf"), F.col("pattern")).alias("template_key"))
    # names and ids go to the intervals, which are few and, once written, of known size
    intervals = T.assignment_intervals(keyed, book).join(named, home).join(known, home)
    intervals = materialise(intervals, "intervals")
    tagged = T.assign_templates(events.drop("template_id"), intervals, message, order, number)
    return tagged.drop(*home)


def tag_templates(
    events: DataFrame,
    path: str,
    checkpoint: str,
    message: str = "message",
    order: str = "ts",
    trigger: dict | None = None,
    store: str | None = None,
    **mining: int | float,
) -> StreamingQuery:
    """Tag events with templates as they arrive, into the table ``path/events``.

    With ``store``, into the event table of that path, each id once.

    Batches count as arriving one after the other; ``order`` rules within a batch.
    ``mining`` sets ``depth``, ``sim_threshold`` or ``max_children``.
    """

    def tag(batch: DataFrame, number: int) -> None:
        tag_batch(batch, number, path, message, order, store=store, **mining)

    return _each_batch(events, checkpoint, tag, trigger)


def start_all(
    events: DataFrame,
    path: str,
    checkpoint: str,
    by: Sequence[str] = (),
    bucket_seconds: int = 2,
    trigger: dict | None = None,
    delay: str = DELAY,
) -> list[StreamingQuery]:
    """Keep the events with their template, watch the ERROR and FATAL ones for spikes.

    Error events later than ``delay`` are kept, but no longer counted in a bucket.
    """
    errors = events.filter("level >= 4")
    return [
        tag_templates(
            events,
            f"{path}/templates",
            f"{checkpoint}/templates",
            trigger=trigger,
            store=f"{path}/events",
        ),
        watch_spikes(
            errors,
            f"{path}/spikes",
            f"{checkpoint}/spikes",
            by,
            bucket_seconds,
            delay=delay,
            trigger=trigger,
        ),
    ]
