"""Every registered query against its DuckDB oracle on the smallest tables,
and the entry function (the driver does the same at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tablewright.sources.tables import TABLES
from tests.conftest import SF0001

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# Two comparisons of five models with six fits each: minutes even on these tables.
SLOW = {"ml_compare_regressors"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF0001).toPandas()
    o = con.execute(SQL[name]).fetchdf()
    sc, sr = _rows(s)
    oc, orr = _rows(o)
    assert sc == oc
    assert len(sr) == len(orr)
    for a, b in zip(sr, orr):
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-6, abs=1e-9)
            else:
                assert x == y


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["column", "missing_count", "missing_pct"]
    assert df.count() >= 0
