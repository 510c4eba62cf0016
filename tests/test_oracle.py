"""Every query with SQL is held against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from sediment.plans.catalogue import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(([cell(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        cur = db.execute(ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(got, df.columns) == canonical(cur.fetchall(), names)
