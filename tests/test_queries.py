"""Every registered query of the core library against its DuckDB SQL on the smallest tables, and the stream against the batch."""

import glob
import os

import duckdb
import pytest

from marginalia.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: "null" if v is None else str(v) if isinstance(v, (bool, str)) else f"{float(v):.9g}"
    return sorted(tuple(show(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_stream_equals_batch(spark):
    from marginalia.operators import review

    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {tuple(r) for r in review.review_state(review.review_events(events)).collect()}
    assert {tuple(r) for r in QUERIES["review_state_stream"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_stream_state_is_in_files(spark):
    assert QUERIES["review_state_stream"](spark, SF).inputFiles()
