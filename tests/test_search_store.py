"""Searching, storing and reading events, by example."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import logtables as lt
from logtables.operators import search as S
from logtables.sources import store

NOW = datetime(2026, 1, 2, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture
def events(spark):
    def make(*rows):
        """Rows of message and, optionally, source, level, age in seconds, fields."""
        full = []
        for i, row in enumerate(rows):
            row = {"source": "api", "level": 2, "age": 0, "fields": {}, **row}
            ts = NOW - timedelta(seconds=row["age"])
            full.append((f"id{i}", ts, row["level"], row["source"], row["message"], row["fields"]))
        df = spark.createDataFrame(
            full,
            "event_id string, ts timestamp, level int, source string, message string, fields map<string,string>",
        )
        return df.withColumns(
            {"raw": F.col("message"), "ingest_ts": F.col("ts"), "event_date": F.to_date("ts"),
             "template_id": F.lit(None).cast("bigint")}
        )

    return make


def messages(df):
    return {r.message for r in df.collect()}


def test_phrases(events):
    df = events(
        {"message": "connection timeout to db"},
        {"message": "user logged in"},
        {"message": "Request TIMEOUT, after retries"},
        {"message": "timeouts happen"},
        {"message": "caf\xe9 cr\xe8me"},
        {"message": "other", "source": "timeout-service"},
    )
    hit = {"connection timeout to db", "Request TIMEOUT, after retries", "other"}
    for frame in (df, S.add_search_text(df)):
        assert messages(lt.search(frame, text="timeout")) == hit
        assert messages(lt.search(frame, text=["timeout after"])) == {"Request TIMEOUT, after retries"}
        assert messages(lt.search(frame, text=["CAFE"])) == {"caf\xe9 cr\xe8me"}
        # phrases may hit different columns, but one phrase must lie within one
        assert messages(lt.search(frame, text=["other", "timeout"])) == {"other"}
        assert messages(lt.search(frame, text=["other timeout"])) == set()
        # a phrase without words says nothing beside others, and alone finds nothing
        assert messages(lt.search(frame, text=["***", "logged"])) == {"user logged in"}
        assert messages(lt.search(frame, text=["***"])) == set()


def test_terms(events):
    df = events(
        {"message": "db timeout", "level": 4},
        {"message": "db timeout", "source": "web", "level": 4},
        {"message": "healthy", "level": 4, "fields": {"request_id": "a1"}},
        {"message": "old", "age": 3600, "fields": {"Request_id": "xA1y"}},
        {"message": "100% done_"},
    )
    assert len(lt.search(df, level="error", source="api", text=["timeout"]).collect()) == 1
    assert messages(lt.search(df, last="1m", now=NOW)) == {"db timeout", "healthy", "100% done_"}
    assert messages(lt.search(df, last="1h", now=NOW)) >= {"old"}
    assert messages(lt.search(df, fields={"request_id": "a1"})) == {"healthy"}
    assert messages(lt.search(df, fields={"nope": ""})) == messages(df)
    assert messages(lt.search(df, fields={"request_id": "a1"}, field_mode="loose")) == {"healthy", "old"}
    assert messages(lt.search(df, text=["0% DONE"], text_mode="substring")) == {"100% done_"}
    assert messages(lt.search(df, text=["b_t%out"], text_mode="like")) == {"db timeout"}
    assert len(lt.search(df).collect()) == 5
    assert messages(lt.filter_any(df, "WEB")) == {"db timeout"}
    assert lt.filter_any(df, "").count() == 5
    for bad in ({"level": "bogus"}, {"last": "5x"}, {"last": "abc"}):
        with pytest.raises(ValueError):
            lt.search(df, **bad)


def test_order_and_text(events):
    df = events({"message": "older", "age": 100, "level": 3}, {"message": "newer", "age": 1})
    found = lt.search(df)
    assert [r.message for r in found.collect()] == ["newer", "older"]
    assert [r.message for r in lt.oldest_first(found).collect()] == ["older", "newer"]
    lines = [r.line for r in S.format_events(found).collect()]
    assert lines == ["11:59:59 INFO  [api] newer", "11:58:20 WARN  [api] older"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_store_is_idempotent(spark, events, tmp_path):
    path = str(tmp_path / "events")
    df = events({"message": "a"}, {"message": "b", "age": 90_000, "fields": {"k": "v"}}, {"message": "c"})
    lt.append_events(df.unionByName(df), path)
    lt.append_events(df.unionByName(events({"message": "a"}, {"message": "b"}, {"message": "c"}, {"message": "d"}).filter("message = 'd'")), path)
    stored = lt.read_events(spark, path)
    assert sorted(r.message for r in stored.collect()) == ["a", "b", "c", "d"]
    assert stored.filter("message = 'b'").first().fields == {"k": "v"}
    assert lt.count_events(stored).first().events == 4
    recent = lt.search(stored, last="1h", now=NOW)._jdf.queryExecution().executedPlan().toString()
    filters = recent[recent.index("PartitionFilters") :]
    assert "event_date" in filters[: filters.index("]")]


def test_appends_read_only_what_is_near(spark, tmp_path):
    """Twenty appends to one day: the last reads no more of the day than the second."""
    path = str(tmp_path / "events")

    def batch(minute, n=500):
        return spark.range(n).select(
            F.concat(F.lit(f"{minute}-"), F.col("id").cast("string")).alias("event_id"),
            F.timestamp_millis(F.lit(1_700_006_400_000 + minute * 60_000) + F.col("id")).alias("ts"),
            F.lit(2).alias("level"),
            F.lit("api").alias("source"),
            F.lit("m").alias("message"),
            F.lit("m").alias("raw"),
            F.lit(None).cast("map<string,string>").alias("fields"),
            F.lit(None).cast("timestamp").alias("ingest_ts"),
            F.lit(None).cast("bigint").alias("template_id"),
        ).withColumn("event_date", F.to_date("ts"))

    for minute in range(20):
        lt.append_events(batch(minute), path)
    again = batch(19)
    near = store._near(spark.read.parquet(path), again).select("event_id", "ts")
    assert near.count() == 500
    assert near.collect()
    scan = near._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == 500
    # the same again, with one event inside an earlier batch and one of another day
    more = again.unionByName(batch(3)).unionByName(batch(3000, 1))
    lt.append_events(more, path)
    stored = lt.read_events(spark, path)
    assert stored.count() == 20 * 500 + 1
    assert stored.select("event_id").distinct().count() == 20 * 500 + 1
    lt.append_events(more.limit(0), path)
    assert lt.read_events(spark, path).count() == 20 * 500 + 1


def test_first_copy_wins(events):
    df = events({"message": "a"})
    later = df.withColumns({"ingest_ts": F.expr("ts + interval 1 day"), "level": F.lit(5)})
    (row,) = lt.dedup_events(later.unionByName(df).unionByName(later)).collect()
    assert row.level == 2
    plan = lt.dedup_events(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_accents_as_marks_of_their_own(events):
    df = events({"message": "two cafe\u0301s open"}, {"message": "caf\u00e9s shut"}, {"message": "cafe s"})
    found = lt.search(df, text=["cafes"], now=NOW)
    assert sorted(r.message for r in found.collect()) == ["caf\u00e9s shut", "two cafe\u0301s open"]


def test_files(spark, tmp_path):
    (tmp_path / "app.log").write_bytes(b'{"msg": "one"}\r\n\r\nWARN two\rthree \xff\n')
    (tmp_path / "db.log").write_text("four\n\n")
    lines = lt.read_logs(spark, [str(tmp_path / "app.log"), str(tmp_path / "db.log")])
    assert sorted((r.source, r.value) for r in lines.collect()) == [
        ("app.log", "WARN two"), ("app.log", "three �"), ("app.log", '{"msg": "one"}'), ("db.log", "four"),
    ]
    # file time as ingest time: the same ids when read again
    ids = [sorted(r.event_id for r in lt.parse_logs(lines).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 4
    named = lt.read_logs(spark, str(tmp_path / "db.log"), name="db")
    merged = lt.merge_sources([named, lines.filter("source = 'app.log'")])
    assert sorted({r.source for r in merged.collect()}) == ["app.log", "db"]


def test_results_do_not_depend_on_the_session_zone(spark, events, tmp_path):
    path = str(tmp_path / "events")
    rows = [{"message": f"h{h}", "age": h * 3600} for h in range(30)]

    def results():
        stored = lt.read_events(spark, path)
        recent = sorted(r.message for r in lt.search(stored, last="14h", now=NOW).collect())
        lines = sorted(r.line for r in lt.format_events(stored).collect())
        batch = sorted(r.payload for r in lt.pack_batches(stored).collect())
        return recent, lines, batch

    lt.append_events(lt.parse_logs(events(*rows).select(
        F.concat(F.lit('{"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","msg":"'), "message", F.lit('"}')).alias("value"),
        "source", "ingest_ts",
    )), path)
    want = results()
    assert len(want[0]) == 15
    try:
        for zone in ("Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert results() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    found = lt.search(lt.read_events(spark, path), last="14h", now=NOW)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "event_date" in filters[: filters.index("]")] and "current_timezone" not in filters
