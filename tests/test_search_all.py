"""Filter queries return every match, however many there are."""

import duckdb
import pytest

import __spark_entry__ as entry

from .test_oracles import TABLES, canonical

SF_DIR = "/root/testdata/sf0.01"
FILTERS = "level source field field_loose last substring like combined".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", FILTERS)
def test_no_match_is_cut_off(spark, duck, name):
    want = canonical(duck.execute(entry.oracle_sql()[f"search_{name}"]).df())
    assert canonical(entry.queries()[f"search_{name}"](spark, SF_DIR).toPandas()) == want


def test_the_latest_stay_limited(spark):
    for name in ("search_latest", "search_oldest_first"):
        assert entry.queries()[name](spark, SF_DIR).count() == 100
