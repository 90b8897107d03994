"""The named queries: each takes a session and a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.functions import ids, levels, text, times
from logtables.operators import context, health, parse, search, spikes, templates
from logtables.plans import views
from logtables.scratch import forget, materialise, released, scratch_path
from logtables.sources import batches, files, store
from logtables.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The sample logs span 2024-01-01 to 2024-01-30.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rows(events: DataFrame, *more: Column | str) -> DataFrame:
    """Event columns as plain values, time in microseconds."""
    columns = ["event_id", F.unix_micros("ts").alias("ts_us"), "level", "source", "message", "raw"]
    return events.select(*columns, *more)


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit("")).alias(name)


def _searched(spark: SparkSession, sf_dir: str, **terms) -> DataFrame:
    """All events meeting the terms."""
    return _rows(search.where(views.log_events(spark, sf_dir), **terms))


# Sources and sinks


@query
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    views.logs(spark, sf_dir).select("value").write.text(path)
    return files.read_logs(spark, path, name="app.log").select("source", "value")


def _streamed(
    spark: SparkSession, sf_dir: str, batches: int = 5, order: str = "ingest_ts"
) -> DataFrame:
    """The sample lines as a stream of ``batches`` micro-batches, along ``order``.

    A micro-batch is a file for every core, so that all of them write and read it.
    """
    path = scratch_path(spark, "stream")
    lines = views.logs(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    lines.repartitionByRange(batches * cores, order).write.parquet(path)
    # Files are taken by age; theirs follows the order of their lines.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    storage = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in storage.listStatus(folder)]
    for age, file in enumerate(sorted((f for f in found if "part-" in f.getName()), key=str)):
        storage.setTimes(file, 1_700_000_000_000 + 1000 * age, -1)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", cores)
    return stream.parquet(path)


def _collected(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Everything a stream emits, run to its end into a table."""
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    views.logs(spark, sf_dir).select("value").write.text(path)
    lines = files.stream_logs(spark, path, name="app.log")
    return _collected(spark, lines.select("source", "value"))


@query
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labelled(lines: DataFrame, name: str) -> DataFrame:
        return lines.select(F.lit(name).alias("source"), "value").filter("value <> ''")

    documents = views.doclines(spark, sf_dir).withColumnRenamed("line", "value")
    turns = views.table(spark, sf_dir, "conversations").select(
        F.explode(F.split("text", "\n")).alias("value")
    )
    return files.merge_sources(
        [
            views.logs(spark, sf_dir).select("source", "value"),
            labelled(documents, "documents"),
            labelled(turns, "conversations"),
        ]
    )


@query
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = batches.pack_batches(views.log_events(spark, sf_dir))
    return packed.select(
        "agent_id",
        "chunk",
        "n",
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
    )


def _shipped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sample events as batches, and the same batches in an unknown version."""
    good = batches.pack_batches(views.log_events(spark, sf_dir)).select("payload")
    good = materialise(good, "batches")
    newer = F.replace("payload", F.lit('{"version":1,'), F.lit('{"version":999,'))
    return good, good.select(newer.alias("payload"))


@query
def unpack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, newer = _shipped(spark, sf_dir)
    torn = good.select(F.substring("payload", F.lit(1), F.length("payload") - 1).alias("payload"))
    wrong = F.regexp_replace("payload", '"level":[0-5],', '"level":9,')
    events, _ = batches.unpack_batches(
        files.merge_sources([good, newer, torn, good.select(wrong.alias("payload"))])
    )
    return _rows(events, _field("user_id"), "agent_id")


@query
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batch_totals(files.merge_sources(_shipped(spark, sf_dir)))


@query
def append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events")
    events = materialise(views.log_events(spark, sf_dir), "parsed")
    store.append_events(events.filter("level >= 3"), path)
    store.append_events(events, path)
    return _rows(store.read_events(spark, path))


@query
def count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_events(views.log_events(spark, sf_dir))


@query
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = materialise(views.log_events(spark, sf_dir), "parsed")
    again = events.withColumn("ingest_ts", F.col("ingest_ts") + F.expr("interval 1 day"))
    first = store.dedup_events(again.unionByName(events))
    return _rows(first, F.unix_micros("ingest_ts").alias("ingest_us"))


@query
def format_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.format_events(views.log_events(spark, sf_dir)).select("event_id", "line")


# Columns


def _detected(
    spark: SparkSession, sf_dir: str, detect: parse.Detector, *before: parse.Detector
) -> DataFrame:
    """Extraction by one detector of the lines no earlier detector takes."""
    df = views.logs(spark, sf_dir)
    for i, earlier in enumerate(before):
        df = earlier(df, "value", f"_{i}").filter(f"_{i} is null").drop(f"_{i}")
    return detect(df, "value", "p").filter("p is not null")


def _extracted(df: DataFrame, *more: Column) -> DataFrame:
    time = F.col("p.timestamp").alias("time")
    return df.select("arrival", "p.message", "p.level", time, *more)


@query
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(spark, sf_dir, parse.detect_json)
    return _extracted(found, F.col("p.fields")["user_id"].alias("user_id"))


@query
def parse_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(spark, sf_dir, parse.detect_logfmt)
    return _extracted(found, F.col("p.fields")["user_id"].alias("user_id"))


@query
def parse_leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(_detected(spark, sf_dir, parse.detect_leveled))


@query
def parse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingest_us = F.unix_micros("ingest_ts").alias("ingest_us")
    return _rows(
        views.log_events(spark, sf_dir), "arrival", "format", _field("user_id"), ingest_us
    )


@query
def normalize_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("user_id") % 70).cast("string")
    token = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(number)
    return (
        views.table(spark, sf_dir, "events")
        .select("event_id", "event_type", token.alias("token"))
        .withColumn("level", F.coalesce(levels.normalize_level(F.col("token")), F.lit(-1)))
    )


@query
def scan_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.coalesce(levels.scan_level(F.col("value")), F.lit(-1)).alias("level")
    return views.logs(spark, sf_dir).select("arrival", level)


@query
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(shape: str) -> Column:
        return F.date_format("ts", shape)

    form = F.col("form")
    value = (
        F.when(form == 0, shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
        .when(form == 2, shown("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(form == 3, shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(form == 4, shown("yyyy-MM-dd HH:mm:ss,SSS"))
        .when(form == 5, shown("yyyyMMddHHmmss"))
        .otherwise(shown("yyyy-MM-dd"))
    )
    return (
        views.table(spark, sf_dir, "events")
        .withColumn("form", F.col("event_id") % 7)
        .withColumn("ts_us", F.unix_micros(times.parse_timestamp(value)))
        .select("event_id", "form", F.coalesce("ts_us", F.lit(-1).cast("bigint")).alias("ts_us"))
    )


@query
def event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.log_events(spark, sf_dir)
    made = ids.event_id(F.col("source"), F.col("raw"), F.col("ts"))
    return events.select("arrival", made.alias("event_id"))


@query
def mask_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.doclines(spark, sf_dir)
    masked = text.mask_variables(F.col("line")).alias("masked")
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), masked)


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.pattern_tokens(text.message_pattern(F.col("line")))
    lines = views.doclines(spark, sf_dir).select(F.size(tokens).alias("n_tokens"))
    return lines.groupBy("n_tokens").agg(F.count("*").alias("lines"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens ``t`` of each document line and ``m`` of the line after it."""
    lines = F.split("text", "\n")
    pairs = F.arrays_zip(lines.alias("a"), F.slice(lines, F.lit(2), F.size(lines)).alias("b"))
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = views.spread(documents).select(
        "doc_id", F.posexplode(pairs).alias("line_no", "pair")
    )
    both = both.filter("pair.b is not null")
    t, m = (
        text.pattern_tokens(text.message_pattern(F.col(f"pair.{side}"))) for side in ("a", "b")
    )
    line_no = F.col("line_no").cast("bigint").alias("line_no")
    return both.select("doc_id", line_no, t.alias("t"), m.alias("m"))


@query
def template_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = F.round(text.template_similarity(F.col("t"), F.col("m")), 6)
    pairs = _neighbours(spark, sf_dir)
    return pairs.select("doc_id", "line_no", similarity.alias("similarity"))


@query
def merge_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _neighbours(spark, sf_dir).filter(F.size("t") == F.size("m"))
    merged = F.array_join(text.merge_templates(F.col("t"), F.col("m")), " ")
    return pairs.select("doc_id", "line_no", merged.alias("merged"))


@query
def ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = times.ingest_lag_ms(F.col("ts"), F.col("ingest_ts"))
    return views.log_events(spark, sf_dir).select("event_id", lag.alias("lag_ms"))


# Searches


@query
def search_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, level="warn")


@query
def search_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, source="svc-2")


@query
def search_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, fields={"user_id": "8"})


@query
def search_field_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, fields={"user_id": "4"}, field_mode="loose")


@query
def search_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, last="5d", now=NOW)


@query
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.doclines(spark, sf_dir).withColumnRenamed("line", "message")
    line_no = F.col("line_no").cast("bigint").alias("line_no")
    found = search.where(lines, text=["LÀ", "de"])
    return found.select("doc_id", line_no, "source", "message")


@query
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, text=["DB-3 after"], text_mode="substring")


@query
def search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, text=["user%TOOK"], text_mode="like")


@query
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(
        spark, sf_dir, level="error", source="svc-1", last="20d", now=NOW,
        text=["Failed to connect"],
    )


@query
def search_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(search.search(views.log_events(spark, sf_dir)))


@query
def search_oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(views.log_events(spark, sf_dir), level="error")
    return _rows(search.oldest_first(found))


@query
def search_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.log_events(spark, sf_dir)
    hits = events.filter(F.col("message").contains("db-3")).select("event_id")
    return _rows(search.only_listed(events, hits))


@query
def filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.log_events(spark, sf_dir)
    return _rows(
        search.filter_any(events, "SIGNUP").unionByName(
            search.filter_any(events, "svc-4").filter(~F.lower("message").contains("signup"))
        )
    )


@query
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(search.newest(views.log_events(spark, sf_dir), 2000))


# Buckets and health


@query
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.bucket_counts(views.log_events(spark, sf_dir), ["source"], 3600)


def _plain_scores(scored: DataFrame, *by: str) -> DataFrame:
    z = F.when(F.col("z_score") != float("inf"), F.col("z_score"))
    return scored.select(
        *by,
        "start_ms",
        "count",
        F.round("mean", 6).alias("mean"),
        F.round("stddev", 6).alias("stddev"),
        F.round(z, 6).alias("z_score"),
        "is_anomaly",
    )


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_events(spark, sf_dir).filter(F.col("level") >= levels.ERROR)


@query
def error_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_scores(spikes.spikes(_errors(spark, sf_dir), bucket_seconds=3600))


@query
def source_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _errors(spark, sf_dir)
    return _plain_scores(spikes.spikes(errors, ["source"], bucket_seconds=600), "source")


@query
def recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = spikes.recent_counts(_errors(spark, sf_dir), ["source"], bucket_seconds=3600)
    return recent.select("source", F.array_join("counts", ",").alias("counts"))


@query
def ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.rate_per_second(views.log_events(spark, sf_dir))


@query
def lag_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = health.lag_percentiles(views.log_events(spark, sf_dir))
    return tails.select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = materialise(views.log_events(spark, sf_dir), "parsed")
    lag = times.ingest_lag_ms(F.col("ts"), F.col("ingest_ts")).alias("latency_ms")
    sample = health.latest(
        events.select("ingest_ts", "event_id", lag), [F.desc("ingest_ts"), "event_id"], 1024
    )
    clusters = events.select(text.message_pattern(F.col("message")).alias("p")).distinct()
    snapshot = health.health_snapshot(events, clusters, NOW, 86400, sample)
    return health.status_line(snapshot)


# Patterns, templates, contexts


def _placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as messages, numbered in reading order."""
    place = (F.shiftleft("doc_id", 32) + F.col("line_no")).alias("place")
    return views.doclines(spark, sf_dir).select(place, F.col("line").alias("message"))


def _line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.pattern_counts(_placed_lines(spark, sf_dir), order="place")


@query
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _line_patterns(spark, sf_dir)
    return counts.select("pattern", "count", F.col("at.ord").alias("first_ord"))


@query
def leaf_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = materialise(_line_patterns(spark, sf_dir), "patterns")
    return templates.leaf_keys(patterns)[0].select("pattern", "count", "leaf")


@query
def mine_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, book = templates.mine_templates(_line_patterns(spark, sf_dir))
    return templates.describe_templates(book).select("template_id", "template_key", "template")


@query
def ranked_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed_lines(spark, sf_dir)
    counts = templates.pattern_counts(lines, order="place")
    keyed, book = templates.mine_templates(counts)
    with released(spark) as kept:
        intervals = kept(templates.assignment_intervals(keyed, book), "intervals")
    with released(spark) as kept:
        counted = templates.template_counts(lines, keyed, intervals, order="place")
        counted = kept(counted, "counted")
    forget(keyed)
    forget(intervals)
    named = templates.describe_templates(book).drop("tokens")
    return (
        counted.join(named, ["leaf", "template_no"])
        .select("template_id", "template", "count")
        .orderBy(F.desc("count"), "template_id")
    )


@query
def assign_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.logs(spark, sf_dir).withColumnRenamed("value", "message")
    keyed, book = templates.mine_templates(templates.pattern_counts(lines, order="arrival"))
    intervals = materialise(templates.assignment_intervals(keyed, book), "intervals")
    named = templates.describe_templates(book)
    tagged = templates.tag_events(lines, intervals, named, order="arrival")
    return tagged.select("arrival", "template_id")


@query
def search_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events of the first template."""
    events = materialise(views.log_events(spark, sf_dir), "events")
    keyed, book = templates.mine_templates(templates.pattern_counts(events, order="arrival"))
    intervals = materialise(templates.assignment_intervals(keyed, book), "intervals")
    tagged = templates.tag_events(
        events, intervals, templates.describe_templates(book), order="arrival"
    )
    path = scratch_path(spark, "stored")
    store.append_events(tagged, path)
    return _rows(store.read_events(spark, path).filter("template_id = 0"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events with the masked message as their cluster."""
    events = views.log_events(spark, sf_dir)
    return events.withColumn("pattern", text.message_pattern(F.col("message")))


def _counted(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("pattern").agg(F.count("*").alias("count"))


@query
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.top_templates(_counted(_clusters(spark, sf_dir)), "pattern")


@query
def cluster_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ids.cluster_fingerprint(F.col("pattern"), F.col("count"))
    return _counted(_clusters(spark, sf_dir)).withColumn("fingerprint", made)


@query
def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = context.cluster_samples(_clusters(spark, sf_dir), ["pattern"])
    return samples.select("pattern", F.array_join("samples", "\n").alias("samples"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = materialise(_clusters(spark, sf_dir), "clusters")
    samples = context.cluster_samples(clusters, ["pattern"])
    return context.cluster_context(_counted(clusters), samples, ["pattern"], "pattern")


@query
def cluster_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("pattern", "count", "prompt")


def _summaries(clusters: DataFrame) -> DataFrame:
    """Stored summaries: those of the connection failures."""
    return clusters.filter(F.col("pattern").contains("connect")).select(
        ids.cluster_fingerprint(F.col("pattern"), F.col("count")).alias("fingerprint"),
        F.concat(F.lit("known: "), F.col("pattern")).alias("summary"),
    )


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = materialise(_counted(_clusters(spark, sf_dir)), "clusters")
    made = ids.cluster_fingerprint(F.col("pattern"), F.col("count"))
    return context.attach_summaries(
        clusters.withColumn("fingerprint", made), _summaries(clusters)
    )


@query
def attach_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).select("pattern", "count", "summary")


@query
def summary_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.summary_hit_rate(_attached(spark, sf_dir)).select(
        F.round("hit_rate", 6).alias("hit_rate")
    )


@query
def summarize_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = materialise(_contexts(spark, sf_dir), "contexts")

    def first_line(prompt: str) -> str:
        return "lines of " + prompt.split("\n")[0]

    return context.summarize_missing(contexts, _summaries(contexts), first_line)


# Streams, run to their end


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_logs(_streamed(spark, sf_dir))
    path, checkpoint = scratch_path(spark, "kept"), scratch_path(spark, "checkpoint")
    sent_twice = events.unionByName(events)
    once = jobs.dedup_stream(sent_twice)
    jobs.keep_events(once, path, checkpoint, {"availableNow": True}).awaitTermination()
    return _rows(store.read_events(spark, path))


@query
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_logs(_streamed(spark, sf_dir))
    wanted = [search.filter_any(events, needle) for needle in ("SIGNUP", "svc-4")]
    found = wanted[0].unionByName(wanted[1].filter(~F.lower("message").contains("signup")))
    return _collected(spark, _rows(found))


@query
def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_logs(_streamed(spark, sf_dir))
    return _collected(spark, jobs.closed_buckets(events, ["source"], 3600))


@query
def stream_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = search.where(parse.parse_logs(_streamed(spark, sf_dir, 20)), level="error")
    path, checkpoint = scratch_path(spark, "spikes"), scratch_path(spark, "checkpoint")
    jobs.watch_spikes(
        errors, path, checkpoint, ["source"], 600, trigger={"availableNow": True}
    ).awaitTermination()
    return _plain_scores(spark.read.parquet(f"{path}/scored"), "source")


@query
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_logs(_streamed(spark, sf_dir))
    return _collected(spark, jobs.sliding_rate(events))


@query
def stream_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_logs(_streamed(spark, sf_dir, 3, "arrival"))
    path, checkpoint = scratch_path(spark, "templates"), scratch_path(spark, "checkpoint")
    jobs.tag_templates(
        events, path, checkpoint, message="raw", order="arrival", trigger={"availableNow": True}
    ).awaitTermination()
    return spark.read.parquet(f"{path}/events").select("arrival", "template_id")
