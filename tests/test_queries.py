"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as registered

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("LAUREL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    from laurel.sources.tables import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(str(tuple(clean(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sql, name):
    df = registered.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    oracle = registered.oracle_sql().get(name)
    if oracle is None:
        assert df.columns and rows is not None
        return
    cursor = sql.execute(oracle)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, rows) == comparable(columns, cursor.fetchall())


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns and df.count() > 0
