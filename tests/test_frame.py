"""The feature frame on literal bars, against plain walks."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import frame

DAY = datetime.date(2024, 1, 1)


def bars(spark, n=130, symbols=("a", "b")):
    rng = np.random.default_rng(5)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(0.01 * rng.normal(size=n)))
        rows += [(s, DAY + datetime.timedelta(k), float(close[k] * 1.01), float(close[k] * 0.99), float(close[k])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, ts date, high double, low double, close double")


def test_frame(spark):
    rows, df = bars(spark)
    at = lambda k: DAY + datetime.timedelta(k)
    basis = spark.createDataFrame([(at(3), 0.5), (at(10), None), (at(20), 0.7), (at(20), 0.6)], "ts date, v double")
    own = spark.createDataFrame([("a", at(5), 1.7, "x"), ("a", at(50), -0.2, "y"), ("b", at(-4), 0.3, None), ("z", at(0), 9.0, "z")], "symbol string, ts date, rank double, note string")
    reference = spark.createDataFrame([(at(k), float(k)) for k in range(120)], "ts date, close double")
    got = {(r.symbol, (r.ts - DAY).days): r for r in frame.feature_frame(df.repartition(3), reference, {"basis": basis}, own, ("rank",)).collect()}
    assert len(got) == 260 and [f for f in got["a", 0].asDict()][:2] == ["symbol", "ts"]
    close = [r[4] for r in rows if r[0] == "a"]
    assert got["a", 20].ret_20d == pytest.approx(math.log(close[20] / close[0])) and got["a", 19].ret_20d is None and got["a", 0].ret_1d is None
    r = np.diff(np.log(close))
    assert got["a", 60].realized_vol_30d == pytest.approx(r[30:60].std(ddof=1) * math.sqrt(365)) and got["a", 9].realized_vol_30d is None and got["a", 9].vol_ratio is None
    assert got["a", 60].vol_ratio == pytest.approx(min(5, r[55:60].std(ddof=1) / r[30:60].std(ddof=1)))
    assert got["a", 2].basis is None and got["b", 9].basis == 0.5 and got["a", 15].basis is None and got["a", 129].basis == 0.7
    assert got["a", 4]["rank"] is None and got["a", 6]["rank"] == 1.0 and got["a", 60]["rank"] == 0.0 and got["b", 0]["rank"] == 0.3 and got["b", 0].note is None and got["a", 60].note == "y"
    assert got["a", 50].reference_ma200_flag == 0.0 and got["a", 99].reference_ma200_flag == 1.0 and got["a", 129].reference_ma200_flag == 1.0
    alone = frame.feature_frame(df, reference.limit(0), {}).collect()
    assert len(alone) == 260 and {x.reference_ma200_flag for x in alone} == {0.5} and frame.feature_frame(df.limit(0), reference, {"basis": basis}, own).count() == 0


def test_filled_and_coverage(spark):
    rows = [("a", 1, None, 1.0), ("a", 2, 3.0, float("nan")), ("a", 3, float("inf"), 5.0), ("a", 4, None, None), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double, y double")
    got = {(r.symbol, r.ts): (r.x, r.y, r.filled) for r in frame.model_frame(df, ["x", "y"], {"x": 0.5}).collect()}
    assert got == {("a", 1): (0.5, 1.0, 1), ("a", 2): (3.0, 1.0, 1), ("a", 3): (3.0, 5.0, 1), ("a", 4): (3.0, 5.0, 2), ("b", 1): (0.5, 0.0, 2)}
    cover = {(r.symbol, r.feature): (r.n_rows, r.n_valid, r.first_day, r.last_day) for r in frame.coverage(df, ["x", "y"]).collect()}
    assert cover == {("a", "x"): (4, 1, 2, 2), ("a", "y"): (4, 2, 1, 3), ("b", "x"): (1, 0, None, None), ("b", "y"): (1, 0, None, None)}
