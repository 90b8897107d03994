"""What mining templates moves and leaves on disk (F2 of round 4)."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logtables.operators import templates as T

from .test_templates import Sequential, _many_masks


@pytest.fixture
def tables(spark):
    """Names of the scratch tables that came since."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("logtables/*/*"))
    return lambda: sorted(p.name for p in set(root.glob("logtables/*/*")) - before)


def test_a_large_book_is_looked_up_in_passes(spark, monkeypatch, tables):
    # all lookups of all patterns were shuffled at once
    monkeypatch.setattr(T, "FEW", 1)
    monkeypatch.setattr(T, "LOOKUPS", 5)
    patterns, book, want = _many_masks(spark)
    got = [(r.pattern, r.template_no) for r in T.coverings(patterns, book).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = tables()
    assert left.count("covered") > 1 and set(left) == {"covered", "slots"}


@pytest.mark.parametrize("chunk", [100_000, 20])
def test_mining_leaves_the_patterns_and_the_book(spark, monkeypatch, tables, chunk):
    # each round left all patterns twice, and its book
    monkeypatch.setattr(T, "MASKS", 0)
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(4)) + f" n{i}" for i in range(120)]
    events = spark.createDataFrame(list(enumerate(lines)), "ts bigint, message string")
    model = Sequential()
    for line in lines:
        model.feed(line)
    keyed, book = T.mine_templates(T.pattern_counts(events), chunk=chunk)
    assert set(tables()) <= {"keyed", "templates", "slots"} and tables().count("keyed") == 1
    got = sorted(r.template for r in book.collect())
    assert got == sorted(" ".join(t["tokens"]) for t in model.made)
    assert keyed.count() == 120


def test_counting_moves_no_text(spark):
    # patterns were shuffled as text six times to count them
    rows = [(i, f"job {'abcdefgh'[i % 8]} {'done' if i % 3 else 'failed'} at {'xyz'[i % 3]}") for i in range(60)]
    events = spark.createDataFrame(rows, "ts bigint, message string")
    keyed, book = T.mine_templates(T.pattern_counts(events))
    intervals = T.materialise(T.assignment_intervals(keyed, book), "intervals")
    assert "pattern" not in intervals.columns
    counted = T.template_counts(events, keyed, intervals)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(pattern#" in x]
    assert not moved and counted.agg(F.sum("count")).first()[0] == 60
