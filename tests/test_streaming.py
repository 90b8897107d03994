"""Streaming jobs give what the batch operators give, also over restarts."""

import os
from datetime import datetime, timedelta, timezone

import pytest
import logtables as lt
from logtables.plans import queries
from logtables.streaming import jobs, tables
from logtables.streaming.tables import StateTable
from tests.test_templates import Sequential, stream

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
ONCE = {"availableNow": True}


class Drop:
    """A folder that files are dropped into, one micro-batch per file."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        path.mkdir()

    def put(self, lines, name=None):
        target = self.path / (name or f"{self.n:03}.log")
        target.write_text("".join(line + "\n" for line in lines))
        os.utime(target, (START.timestamp() + self.n, START.timestamp() + self.n))
        self.n += 1

    def lines(self, **options):
        return lt.stream_logs(self.spark, str(self.path), maxFilesPerTrigger=1, **options)

    def events(self):
        return lt.parse_logs(self.lines(name="app"))


@pytest.fixture
def drop(spark, tmp_path):
    return Drop(spark, tmp_path / "in")


def line(seconds, text="m", level="error"):
    at = (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return f'level={level} msg="{text}" ts={at}'


def test_follow_files(spark, drop, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(**options):
        lines = drop.lines(**options).select("source", "value")
        lines.writeStream.option("checkpointLocation", checkpoint).trigger(**ONCE).start(
            out
        ).awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    drop.put(["a", "", "b"])
    assert run() == ["a", "b"]
    drop.put(["c"])
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_follow_from_now_on(spark, drop, tmp_path):
    drop.put(["old"])
    drop.put(["new"])
    out = str(tmp_path / "out")
    lines = drop.lines(since=START + timedelta(seconds=1)).select("value")
    query = lines.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(**ONCE).start(out).awaitTermination()
    assert [r.value for r in spark.read.parquet(out).collect()] == ["new"]


def test_events_kept_once(spark, drop, tmp_path):
    out, checkpoint = str(tmp_path / "events"), str(tmp_path / "cp")

    def run(stream):
        jobs.keep_events(stream, out, checkpoint, ONCE).awaitTermination()
        return sorted(r.message for r in lt.read_events(spark, out).collect())

    drop.put([line(1, "a"), line(1, "a"), line(2, "b")])
    drop.put([line(2, "b"), line(3, "c")])
    assert run(drop.events()) == ["a", "b", "c"]
    drop.put([line(1, "a"), line(90_000, "d")], "resent.log")
    assert run(drop.events()) == ["a", "b", "c", "d"]
    # another query over the same files adds nothing
    checkpoint = str(tmp_path / "cp2")
    assert run(drop.events()) == ["a", "b", "c", "d"]


def test_duplicates_dropped_in_flight(spark, drop, tmp_path):
    drop.put([line(1, "a"), line(2, "b"), line(1, "a")])
    drop.put([line(2, "b"), line(3, "c")])
    out = str(tmp_path / "out")
    once = jobs.dedup_stream(drop.events()).select("message")
    query = once.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(**ONCE).start(out).awaitTermination()
    assert sorted(r.message for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def buckets(counts):
    return [line(10 * i + j / 1000) for i, n in counts for j in range(n)]


def test_spikes_equal_batch(spark, drop, tmp_path):
    counts = [(i, 3 + i % 3) for i in range(40) if i % 7] + [(60, 9), (61, 50), (70, 2)]
    path, checkpoint = str(tmp_path / "spikes"), str(tmp_path / "cp")

    def run():
        jobs.watch_spikes(
            drop.events(), path, checkpoint, ["source"], window=8, delay="15 seconds", trigger=ONCE
        ).awaitTermination()

    for part in (counts[:10], counts[10:25], counts[25:30]):
        drop.put(buckets(part))
    # late but within the delay: counted in its bucket
    drop.put([line(10 * counts[29][0] - 9.5), *buckets(counts[30:])])
    run()
    drop.put(buckets([(80, 1), (200, 1)]))
    run()
    run()
    columns = ["source", "start_ms", "count", "mean", "stddev", "z_score", "is_anomaly"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/scored").select(columns).collect())
    lines = lt.read_logs(spark, str(tmp_path / "in"), name="app")
    batch = lt.spikes(lt.parse_logs(lines), ["source"], window=8).select(columns)
    assert got == sorted(tuple(r) for r in batch.collect())
    # both the first burst after silence and the larger one after it
    assert [r[2] for r in got if r[-1]] == [9, 50]


def test_late_events_dropped(spark, drop, tmp_path):
    drop.put(buckets([(0, 2), (10, 1)]))
    drop.put(buckets([(20, 1)]))
    drop.put(buckets([(0, 5), (40, 1)]))
    out = str(tmp_path / "out")
    closed = jobs.closed_buckets(drop.events(), (), 10, "10 seconds")
    query = closed.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(**ONCE).start(out).awaitTermination()
    origin = int(START.timestamp() * 1000)
    got = sorted(((r.start_ms - origin) // 10_000, r["count"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2), (10, 1), (20, 1)]


def test_spikes_over_many_batches_and_restarts(spark, drop, tmp_path):
    """Two series over 24 files, the query stopped and started again; state stays small."""
    path, checkpoint = str(tmp_path / "spikes"), str(tmp_path / "cp")
    for part in range(24):
        name = "api" if part % 3 else "web"
        rows = [line(30 * part + 10 * i + j / 100) for i in range(3) for j in range(2 + (part * i) % 5)]
        rows += [line(30 * part + 5, f"{name} broke")] * (40 if part in (11, 19) else 1)
        drop.put(rows)
        if part == 23:
            drop.put([line(5000)])  # closes all before it
        if part in (7, 15, 23):
            jobs.watch_spikes(
                drop.events(), path, checkpoint, ["message"], window=6, delay="5 seconds", trigger=ONCE
            ).awaitTermination()
    columns = ["message", "start_ms", "count", "mean", "stddev", "z_score", "is_anomaly"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/scored").select(columns).collect())
    lines = lt.read_logs(spark, str(tmp_path / "in"), name="app")
    batch = lt.spikes(lt.parse_logs(lines), ["message"], window=6, include_open=True)
    last = int(START.timestamp() * 1000) + 5_000_000
    want = [tuple(r) for r in batch.select(columns).collect() if r.start_ms < last]
    assert got == sorted(want) and any(r[-1] for r in got)
    # no table of all buckets is kept beside the result
    assert sorted(p.name for p in (tmp_path / "spikes").iterdir()) == ["scored"]


def test_one_series_and_null_series(spark, drop, tmp_path):
    drop.put(buckets([(i, 2 + i % 2) for i in range(12)]))
    drop.put(buckets([(12, 30), (40, 1)]))
    for by, out in (((), "a"), (("template_id",), "b")):
        path = str(tmp_path / out)
        jobs.watch_spikes(
            drop.events(), path, f"{path}-cp", by, window=8, delay="5 seconds", trigger=ONCE
        ).awaitTermination()
        columns = ["start_ms", "count", "mean", "stddev", "z_score", "is_anomaly"]
        got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/scored").select(columns).collect())
        lines = lt.read_logs(spark, str(tmp_path / "in"), name="app")
        want = lt.spikes(lt.parse_logs(lines), by, window=8).select(columns).collect()
        assert got == sorted(map(tuple, want)) and got[-1][-1]


def test_state_table_reads_no_more_with_more_batches(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), "k int, v int", ["k"])
    want, files = {}, {}
    for number in range(50):
        assert {r.k: r.v for r in table.read(number).collect()} == want
        files[number] = len(table.folders(number))
        rows = [(number % 7, number), (number % 5 + 10, -number)]
        for _ in range(1 + (number % 13 == 9)):  # some batches are repeated
            table.write(spark.createDataFrame(rows, "k int, v int").coalesce(1), number)
        want |= dict(rows)
    assert max(files.values()) == files[10] + 9 == 10 and files[49] <= 10
    # what no batch asks for any more is gone
    left = [int(p.name) for p in (tmp_path / "s/changes").iterdir()]
    assert min(left) >= 40 - 10 and len(list((tmp_path / "s/base").iterdir())) <= 2


def test_templates_over_many_batches(spark, tmp_path, monkeypatch):
    """Batches beyond several compactions; the last one opens no more folders than early ones."""
    monkeypatch.setattr(tables, "EVERY", 3)
    messages = stream(8, 60)
    model = Sequential(limit=3)
    want = dict(enumerate(model.feed(m) for m in messages))
    opened, folders = [], StateTable.folders
    monkeypatch.setattr(
        StateTable, "folders", lambda self, before: opened.append((before, n := folders(self, before))) or n
    )
    path = str(tmp_path / "t")
    for number in range(15):
        part = list(enumerate(messages))[4 * number : 4 * number + 4]
        batch = spark.createDataFrame(part, "n long, message string").coalesce(1)
        jobs.tag_batch(batch, number, path, order="n", max_children=3, chunk=7)
    got = {r.n: r.template_id for r in spark.read.parquet(f"{path}/events").collect()}
    assert got == want
    most = {n: max(len(f) for b, f in opened if b == n) for n in (5, 14)}
    assert most[14] <= most[5] <= 3


def test_sliding_rate(spark, drop, tmp_path):
    drop.put([line(s) for s in (0, 0.5, 2, 6)])
    drop.put([line(100)])
    out = str(tmp_path / "out")
    rate = jobs.sliding_rate(drop.events(), time="ts", delay="1 second")
    query = rate.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(**ONCE).start(out).awaitTermination()
    origin = int(START.timestamp())
    got = {r.second - origin: r.rate for r in spark.read.parquet(out).collect()}
    assert got == {0: 0.4, 1: 0.4, 2: 0.6, 3: 0.6, 4: 0.6, 5: 0.2, 6: 0.4, 7: 0.2, 8: 0.2, 9: 0.2, 10: 0.2}


@pytest.mark.parametrize("seed,limit", [(3, 3), (4, 100)])
def test_templates_equal_sequential_model(spark, tmp_path, seed, limit):
    messages = stream(seed, 90)
    model = Sequential(limit=limit)
    want = dict(enumerate(model.feed(m) for m in messages))
    path = str(tmp_path / "t")
    for number, start in enumerate(range(0, 90, 30)):
        part = list(enumerate(messages))[start : start + 30]
        for _ in range(1 + (number == 1)):  # one batch is repeated, as after a failure
            batch = spark.createDataFrame(part, "n long, message string")
            jobs.tag_batch(batch, number, path, order="n", max_children=limit, chunk=7)
    got = {r.n: r.template_id for r in spark.read.parquet(f"{path}/events").collect()}
    assert got == want


def test_all_jobs_together(spark, drop, tmp_path):
    drop.put([line(s, f"failed to reach db-{s}") for s in range(30)])
    drop.put([line(500, "other thing"), line(2000, "last")])
    for query in jobs.start_all(drop.events(), str(tmp_path / "o"), str(tmp_path / "c"), trigger=ONCE):
        query.awaitTermination()
    stored = lt.read_events(spark, str(tmp_path / "o/events"))
    assert stored.count() == 32
    assert spark.read.parquet(str(tmp_path / "o/spikes/scored")).count() == 16
    assert [r[1] for r in sorted(stored.groupBy("template_id").count().collect())] == [30, 1, 1]


def test_filter_and_search_on_a_stream(spark, drop, tmp_path):
    drop.put([line(1, "alpha"), line(2, "beta", "info"), line(3, "alphabet")])
    out = str(tmp_path / "out")
    found = lt.filter_any(lt.where(drop.events(), level="error", text=["alpha"]), "ALPHA")
    query = found.select("message").writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(**ONCE).start(out).awaitTermination()
    assert [r.message for r in spark.read.parquet(out).collect()] == ["alpha"]


def test_spike_state_has_no_more_parts_than_cores(spark, drop, tmp_path):
    # every batch opened the state of all shuffle partitions, twice
    drop.put(buckets([(0, 2), (1, 3), (40, 1)]))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        jobs.watch_spikes(
            drop.events(), str(tmp_path / "s"), str(tmp_path / "cp"), ["source"], trigger=ONCE
        ).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    cores = spark.sparkContext.defaultParallelism
    for operator in (tmp_path / "cp" / "state").iterdir():
        parts = [p for p in operator.iterdir() if p.name.isdigit()]
        assert 0 < len(parts) <= cores


def test_a_micro_batch_of_the_sample_is_a_file_for_every_core(spark, tmp_path):
    # F4, F7, F8: one task wrote and one read each micro-batch
    rows = spark.range(2000).selectExpr(
        "id as event_id", "timestamp_seconds(1704067200 + id * 60) as ts", "id % 7 as user_id",
        "'click' as event_type", "cast(id as double) as value", "'' as props",
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    stream = queries._streamed(spark, str(tmp_path), 3, "arrival")
    path, cores = str(tmp_path / "out"), spark.sparkContext.defaultParallelism
    seen = []

    def note(batch, number):
        row = batch.selectExpr(
            "min(arrival)", "max(arrival)", "count(*)", "count(distinct file)"
        )
        seen.append(tuple(row.first()))

    stream.selectExpr("*", "input_file_name() as file").writeStream.foreachBatch(note).option("checkpointLocation", path).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert len(seen) == 3 and sum(n for _, _, n, _ in seen) == 2000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert all(files == cores for *_, files in seen)
