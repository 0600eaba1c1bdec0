"""Queries against DuckDB at the smallest scale, and the entry."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from candlewright import catalog
from candlewright.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return ""
        return f"{float(v):.6g}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(text, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
