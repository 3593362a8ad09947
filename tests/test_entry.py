"""The driver's contract, and every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as E
from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
OWN = sorted(k for k in E.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value) + 0.0:.6g}"
    return str(value)[:10] if type(value).__name__ in ("datetime", "date", "Timestamp") else str(value)


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sql, name):
    got = E.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    out = sql.execute(E.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in out.fetchall())
