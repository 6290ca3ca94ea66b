"""Queries of the operators against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from marginalia.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op5_license_scan", "op6_benchmark_leaks", "op11_text_density", "op13_prefix_trie"])
def test_oracle(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = duck.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(str(r[c]) for c in want.columns) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
