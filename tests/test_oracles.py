"""Each query against its SQL in DuckDB, column by column, over a small table."""

import os

import duckdb
import pytest

from pointloom.plans.catalog import ORACLES, QUERIES

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = ["embeddings", "events"]


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(v[i] for i in order) for v in values)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DIR)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert got
    if name not in ORACLES:
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    want = rows(names, want.fetchall())
    assert len(got) == len(want)
    assert got == want
    wide = {"bigint": "int", "int": "int"}
    assert all(wide.get(t, t) in ("int", "double", "string") for _, t in found.dtypes)
