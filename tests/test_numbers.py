"""Buckets, spikes, rates, numbering and batches against plain models."""

import json
import math
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import logtables as lt
from logtables.operators import health, numbering
from logtables.operators.numbering import numbered
from logtables.sources.batches import unpack_batches

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at_buckets(spark, counts, seconds=10, by="s"):
    rows = [
        (by, START + timedelta(seconds=seconds * i, microseconds=j))
        for i, n in counts
        for j in range(n)
    ]
    return spark.createDataFrame(rows, "series string, ts timestamp")


def scored(counts, window, k=3.0, floor=5):
    """Each non-empty bucket against the zero-filled window before it."""
    filled = dict(counts)
    first = min(i for i, n in counts if n)
    out = {}
    for i, n in sorted(filled.items()):
        if not n:
            continue
        past = [filled.get(j, 0) for j in range(max(first, i - window), i)]
        mean = statistics.fmean(past) if past else 0.0
        std = statistics.pstdev(past) if len(past) > 1 else 0.0
        if len(past) < 2:
            z = 0.0
        elif std > 0:
            z = (n - mean) / std
        else:
            z = math.inf if n > mean else 0.0
        out[i] = (n, mean, std, z, len(past) >= 2 and n >= floor and z >= k)
    return out


@pytest.mark.parametrize("seed,chunk", [(0, 4096), (1, 12), (2, 10)])
def test_spikes_equal_zero_filled_model(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(numbering, "CHUNK", chunk)
    rng = random.Random(seed)
    counts = [(i, rng.choice([0, 0, 1, 2, 3, 9])) for i in range(3, 70)] + [(200, 7), (201, 40)]
    want = scored(counts, 10)
    origin = int(START.timestamp() * 1000)
    got = {}
    df = at_buckets(spark, counts)
    for r in lt.spikes(df, ["series"], window=10, include_open=True).collect():
        got[(r.start_ms - origin) // 10_000] = (r["count"], r.mean, r.stddev, r.z_score, r.is_anomaly)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and got[i][4] == want[i][4]
        assert got[i][1:4] == pytest.approx(want[i][1:4], abs=1e-9)
    closed = {r.start_ms for r in lt.spikes(df, window=10).collect()}
    assert {(s - origin) // 10_000 for s in closed} == want.keys() - {201}


def test_spike_examples(spark):
    def flagged(counts):
        rows = lt.spikes(at_buckets(spark, counts), window=10, include_open=True).collect()
        return [r["count"] for r in rows if r.is_anomaly]

    assert flagged([(i, 10) for i in range(20)]) == []
    assert flagged([(i, 10) for i in range(12)] + [(12, 100)]) == [100]
    assert flagged([(i, 0 if i % 2 else 1) for i in range(10)] + [(10, 3)]) == []


def test_recent_counts(spark):
    df = at_buckets(spark, [(0, 2), (3, 1), (4, 5)]).unionByName(at_buckets(spark, [(7, 1)], by="one"))
    got = {r.series: r.counts for r in lt.recent_counts(df, ["series"], window=30).collect()}
    assert got == {"s": [2, 0, 0, 1], "one": []}
    got = {r.series: r.counts for r in lt.recent_counts(df, ["series"], window=2).collect()}
    assert got["s"] == [0, 1]


def test_rates(spark):
    marks = [(0, 3), (1, 2), (4, 5), (9, 1)]
    rows = [(START + timedelta(seconds=s, milliseconds=j),) for s, n in marks for j in range(n)]
    df = spark.createDataFrame(rows, "ingest_ts timestamp")
    origin = int(START.timestamp())
    got = {r.second - origin: r.rate for r in lt.rate_per_second(df).collect()}
    assert got == {0: 0.6, 1: 1.0, 4: 2.0, 9: 0.2}
    at = {s: lt.ingest_rate(df, START + timedelta(seconds=s)).first().rate for s in (4, 5, 20)}
    assert at == {4: 2.0, 5: 1.4, 20: 0.0}


def test_latest_of_a_large_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.randint(0, 300), i, {"k": "v"}) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int, m map<string,string>")
    for n in (3, 40, 5000):
        got = sorted((r.k, r.v, r.i) for r in lt.latest(df, [F.desc("v"), "i"], n, ["k"]).collect())
        want = [
            r[:3]
            for k in ("cold", "hot")
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:n]
        ]
        assert got == sorted(want)


def test_percentiles_and_status(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    row = lt.percentiles(df, "v").first()
    assert (row.p50, row.p95) == (50.5, pytest.approx(95.05))
    row = lt.percentiles(df.filter("v < 0"), "v").first()
    assert (row.p50, row.p95) == (0.0, 0.0)
    events = spark.createDataFrame(
        [("a", START, START + timedelta(seconds=1)), ("b", START, START + timedelta(seconds=3))],
        "event_id string, ts timestamp, ingest_ts timestamp",
    )
    snapshot = lt.health_snapshot(events, df, now=START + timedelta(seconds=3))
    line = lt.status_line(snapshot, queue_depth=7, hit_rate=0.5).first().status
    assert line == "in 0.4/s  |  q 7  |  lag 3000ms  |  clusters 100  |  total 2  |  ai-cache 50%"


def test_numbered_with_one_large_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", i) for i in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int")
    got = {(r.k, r.i): r.n for r in numbered(df, ["k"], ["i"], "n").collect()}
    want, seen = {}, Counter()
    for k, i in sorted(rows):
        want[(k, i)] = seen[k]
        seen[k] += 1
    assert got == want
    assert sorted(r.n for r in numbered(df, [], ["i"], "n").collect()) == list(range(5000))


def test_batches_round_trip(spark):
    rows = [
        (f"id{i}", START + timedelta(milliseconds=i * 7), i % 6, "api" if i % 3 else 'q"\\', f"m {i} \xe9", f'raw "{i}"', {"n": str(i)})
        for i in range(250)
    ]
    events = spark.createDataFrame(
        rows,
        "event_id string, ts timestamp, level int, source string, message string, raw string, fields map<string,string>",
    )
    packed = lt.pack_batches(events, batch_size=20)
    sizes = {(r.agent_id, r.chunk): r.n for r in packed.collect()}
    assert max(sizes.values()) == 20 and sum(sizes.values()) == 250
    body = json.loads(packed.filter("chunk = 0 and agent_id = 'api'").first().payload)
    assert (body["version"], body["agent_id"], len(body["events"])) == (1, "api", 20)
    assert [e["ts"] for e in body["events"]] == sorted(e["ts"] for e in body["events"])
    assert body["events"][0] == {
        "ts": "2026-01-01T00:00:00.007000+00:00", "level": 1, "source": "api",
        "message": "m 1 \xe9", "raw": 'raw "1"', "fields": {"n": "1"},
    }
    unpacked, refused = unpack_batches(packed)
    assert refused.count() == 0
    columns = ["ts", "level", "source", "message", "raw", "fields"]
    got = sorted(str(r) for r in unpacked.select(columns).collect())
    assert got == sorted(str(r) for r in events.select(columns).collect())


def test_refused_batches(spark):
    event = {"ts": "2026-01-01T00:00:00", "level": 1, "source": "s", "message": "m", "raw": "r"}

    def batch(**change):
        return json.dumps({"version": 1, "agent_id": "a", "events": [event], **change})

    payloads = {
        "ok": batch(),
        "no agent": json.dumps({"version": 1, "events": [event]}),
        "no events": batch(events=[]),
        "version": batch(version=999),
        "no version": json.dumps({"events": []}),
        "level": batch(events=[event, {**event, "level": 9}]),
        "level word": batch(events=[{**event, "level": "x"}]),
        "time": batch(events=[{**event, "ts": "yesterday"}]),
        "missing": batch(events=[{k: v for k, v in event.items() if k != "raw"}]),
        "torn": batch()[:-1],
        "two": batch() + batch(),
        "list": "[1]",
        "empty": "",
    }
    df = spark.createDataFrame([(v,) for v in payloads.values()], "payload string")
    events, refused = unpack_batches(df)
    assert sorted(r.agent_id for r in events.collect()) == ["a", "unknown"]
    assert events.first().ts == datetime(2026, 1, 1)
    reasons = {r.payload: r.reason for r in refused.collect()}
    got = {name: reasons.get(payload) for name, payload in payloads.items()}
    assert [n for n, reason in got.items() if reason is None] == ["ok", "no agent", "no events"]
    assert got["version"] == got["no version"] == "unsupported version"
    assert got["level"] == "level out of range"
    assert got["missing"] == got["time"] == got["level word"] == "event field missing or malformed"
    assert got["torn"] == got["two"] == got["list"] == "not one JSON object"
    totals = {r.agent_id: (r.batches, r.refused, r.events_received) for r in lt.batch_totals(df).collect()}
    assert totals["a"] == (2, 5, 1)


def test_summaries(spark):
    contexts = spark.createDataFrame(
        [("f1", "p1"), ("f2", "p2"), ("f3", "bad"), ("f4", "slow")], "fingerprint string, prompt string"
    )
    known = spark.createDataFrame([("f1", "s1")], "fingerprint string, summary string")

    def answer(prompt):
        import time

        if prompt == "bad":
            raise RuntimeError("no answer")
        if prompt == "slow":
            time.sleep(3)
        return "about " + prompt

    got = {r.fingerprint: r.summary for r in lt.summarize_missing(contexts, known, answer, timeout=0.5).collect()}
    assert got == {"f2": "about p2", "f3": None, "f4": None}
    off = lt.summarize_missing(contexts, known, None).collect()
    assert [r.summary for r in off] == [None] * 3
    attached = lt.attach_summaries(contexts, known)
    assert lt.summary_hit_rate(attached).first().hit_rate == 0.25
    assert lt.summary_hit_rate(attached.filter("false")).first().hit_rate == 0.0


def test_cluster_text(spark):
    rows = [("t", START + timedelta(seconds=i), f"e{i:02}", f"line {i}") for i in range(30)]
    events = spark.createDataFrame(rows, "template string, ts timestamp, event_id string, raw string")
    samples = lt.cluster_samples(events, ["template"])
    assert samples.first().samples == [f"line {i}" for i in range(10, 30)]
    counted = events.groupBy("template").agg(F.count("*").alias("count"))
    row = lt.cluster_context(counted, samples, ["template"]).first()
    quoted = "\n".join(f"line {i}" for i in range(10, 25))
    assert row.prompt == f"Template: t\nOccurrences: 30\nSample lines:\n{quoted}"
    timed = counted.withColumn("time_range", F.lit("noon"))
    assert "\nTime range: noon\nSample" in lt.cluster_context(timed, samples, ["template"]).first().prompt
    prints = {
        n: spark.range(1).select(lt.cluster_fingerprint(F.lit("t"), F.lit(n))).first()[0] for n in (10, 99, 100)
    }
    assert prints[10] == prints[99] != prints[100]
    top = lt.top_templates(spark.createDataFrame([("a", 1200), ("b", 150), ("c", 149)], "template string, count int"))
    assert [tuple(r) for r in lt.template_table(top).collect()] == [
        ("1,200", "█" * 4, "a"), ("150", "", "b"), ("149", "", "c"),
    ]


def test_null_series_and_agents_count(spark):
    rows = [(None if i % 2 else "a", START + timedelta(seconds=i), f"e{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "template string, ts timestamp, event_id string")
    got = lt.spikes(df, ["template"], include_open=True).groupBy("template").sum("count").collect()
    assert {r.template: r[1] for r in got} == {None: 20, "a": 20}
    assert {r.template for r in lt.recent_counts(df, ["template"]).collect()} == {None, "a"}
    plan = lt.spikes(df, ["template"])._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan  # the events aren't read again, let alone twice
    events = lt.parse_logs(df.select(F.col("event_id").alias("value"), "ts", F.col("template").alias("agent_id")).drop("ts"))
    assert lt.pack_batches(events).agg(F.sum("n")).first()[0] == 40


def test_summaries_are_kept(spark, tmp_path):
    path, asked = str(tmp_path / "summaries"), str(tmp_path / "asked")
    contexts = spark.createDataFrame([(f"f{i}", f"p{i}") for i in range(30)], "fingerprint string, prompt string")

    def answer(prompt):
        with open(asked, "a") as file:
            file.write("x")
        return None if prompt == "p3" else f"about {prompt}"

    first = lt.summarize(contexts, path, answer)
    assert lt.summary_hit_rate(first).first().hit_rate == pytest.approx(29 / 30)
    with open(asked) as file:
        assert len(file.read()) == 30
    again = lt.summarize(contexts, path, lambda p: "late answer")
    got = {r.fingerprint: r.summary for r in again.collect()}
    assert got["f3"] == "late answer" and got["f4"] == "about p4"
    assert lt.summary_hit_rate(again).first().hit_rate == 1.0


def test_batches_are_read_once(spark):
    # filter, reason and events each read the JSON again
    df = spark.createDataFrame([('{"version":1,"agent_id":"a","events":[]}',)], "payload string")
    events, _ = unpack_batches(df)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
