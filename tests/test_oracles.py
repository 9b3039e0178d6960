"""Every query that SQL can say, against DuckDB on the same tables; every other one must give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tideglass.plans import all_queries  # noqa: F401
from tideglass.plans.query import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    if isinstance(v, (bool, int)) or hasattr(v, "dtype") and v.dtype.kind in "iub":
        return f"{float(v):.6g}"
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        return f"{float(v):.6g}" if abs(float(v)) > 1e-6 else "0"
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.body is not None))
def test_same_as_sql(spark, duck, name):
    q = QUERIES[name]
    got, want = rows(q.run(spark, SF).toPandas()), rows(duck.execute(q.sql()).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w][:3] == []


#: Enough history for every model needs the larger table.
@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.body is None))
def test_has_rows(spark, name):
    assert QUERIES[name].run(spark, "/root/testdata/sf0.01").count() > 0
