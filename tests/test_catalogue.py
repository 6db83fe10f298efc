"""Queries of the catalogue against their SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.functions import text
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, (float, np.floating)) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, (datetime.datetime, datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(v))[:19]
    return str(list(v)) if isinstance(v, np.ndarray) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(spark, duck, query, sql):
    got = query(spark, SF).toPandas()
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    rows = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()]
    assert sorted(columns) == sorted(got.columns)
    own = [tuple(plain(v) for v in r) for r in got[sorted(got.columns)].itertuples(index=False)]
    assert sorted(own, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    same(spark, duck, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_stream_equals_batch(spark):
    key = ["portfolio", "arrival"]
    a = catalogue.QUERIES["stream_accept"](spark, SF).toPandas().sort_values(key)
    b = catalogue.QUERIES["accept_ladder"](spark, SF).where("status not in ('stale', 'incomplete')").toPandas().sort_values(key)
    assert a[key + ["status"]].values.tolist() == b[key + ["status"]].values.tolist()


def test_html_rows():
    page = "<table><tr><th>Date</th></tr><tr><td>2024-01-15<td> Team  vesting</td></tr></table><p>x</p><table><tr><td>a</td></tr></table>"
    assert text.html_tables(page) == [(0, 0, ["Date"]), (0, 1, ["Team vesting"]), (1, 0, ["a"])] and text.html_tables(None) == []
