"""A source that is missing or raises is a row of the status; the others go on."""

import pytest
from pyspark.sql import functions as F

import logtables as lt
from logtables.streaming.supervise import follow_sources

ONCE = {"availableNow": True}


@pytest.fixture
def folders(tmp_path):
    for name in ("good", "better", "bad"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.log").write_text(f"{name} {i}\nagain {i}\n")
    return tmp_path


def rows(spark, path):
    return sorted(r.value for r in spark.read.parquet(str(path)).collect())


def test_one_missing_one_raising(spark, folders):
    def lines(name):
        return lambda: lt.stream_logs(spark, str(folders / name), maxFilesPerTrigger=1).select("value")

    def raising():
        line = F.col("value")
        return lines("bad")().select(
            F.when(line.contains("2"), F.raise_error(F.lit("torn line"))).otherwise(line).alias("value")
        )

    out = folders / "out"
    watch = follow_sources(
        spark,
        {"good": lines("good"), "later": lines("later"), "bad": raising, "better": lines("better")},
        str(out), str(folders / "cp"), ONCE, retries=1,
    )
    watch.wait()
    for name in ("good", "better"):
        assert rows(spark, out / name) == sorted(f"{w} {i}" for w in (name, "again") for i in range(3))
    status = {r.source: r for r in watch.status().collect()}
    assert {n: r.state for n, r in status.items()} == {
        "good": "done", "better": "done", "later": "failed", "bad": "failed"
    }
    assert status["bad"].error and status["later"].failures == 2 and status["good"].error is None
    # the folder appears: that source is taken up, the others aren't read twice
    (folders / "later").mkdir()
    (folders / "later" / "0.log").write_text("here now\n")
    watch.revive()
    watch.wait()
    assert rows(spark, out / "later") == ["here now"]
    assert {r.source: r.state for r in watch.status().collect()}["later"] == "done"
    assert len(rows(spark, out / "good")) == 6
    watch.stop()


def test_no_sources(spark, tmp_path):
    watch = follow_sources(spark, {}, str(tmp_path / "o"), str(tmp_path / "c"))
    watch.wait()
    assert watch.status().count() == 0
