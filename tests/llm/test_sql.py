"""Queries that SQL can express, against DuckDB over a small table."""

import math
import os

import duckdb
import pytest

from pointloom.llm.queries import ORACLES, QUERIES

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    found = QUERIES[name](spark, DIR)
    names = sorted(found.columns)
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    assert sorted(d[0] for d in want.description) == names
    at = [[d[0] for d in want.description].index(c) for c in names]
    want = sorted(tuple(r[i] for i in at) for r in want.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in found.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b)), (a, b)
