"""Every catalogued query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from repolens.plans import catalog

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return float(value) if isinstance(value, Decimal) else value


def rows_of(columns, rows):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, TABLES)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, TABLES).columns


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
