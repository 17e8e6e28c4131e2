"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from sagebase.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables, rightly.
EMPTY = set()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return ""
        return f"{round(float(v), 6):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(getattr(v, "item", lambda v=v: v)()) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = db.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.limit(1).count() == 1 and len(set(got.columns)) == len(got.columns)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
