"""Every query with a DuckDB counterpart gives the same rows."""

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    # Whole numbers with nulls are floats from Spark, but a type of their own from DuckDB.
    nullable = frame.select_dtypes("Int64").columns
    frame = frame.astype({c: "float64" for c in nullable})
    rows = [
        tuple("NULL" if v is None or v != v else repr(v) for v in row)
        for row in zip(*(frame[c].tolist() for c in frame.columns))
    ]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: str(t) for c, t in got.dtypes.items()} == {
        c: str(t).replace("Int64", "float64") for c, t in want[list(got.columns)].dtypes.items()
    }
    left, right = canonical(got), canonical(want)
    assert len(left) == len(right)
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    assert not differing, differing[:3]
    assert len(left) > 0


def test_every_query_named(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
