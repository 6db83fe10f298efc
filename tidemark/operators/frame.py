"""The frame that models read: a row per symbol and day with all features as they were known then, and its filled form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows

#: Features of the bars themselves, in order.
OWN = ["ret_1d", "ret_5d", "ret_20d", "realized_vol_30d", "vol_ratio", "dvol_zscore"]
FLAG = "reference_ma200_flag"


def bar_features(bars: DataFrame) -> DataFrame:
    """(symbol, ts, *OWN): returns over 1, 5 and 20 bars, volatility of a year, short over long volatility, and how unusual the smoothed range is.

    Windows are of a symbol's bars; a bar of a day is met once.
    """
    w = windows.series(["symbol"], "ts")
    c = F.col
    mid = (c("high") + c("low")) / 2
    rows = bars.select("symbol", "ts", "close", F.when(mid != 0, (c("high") - c("low")) / mid).alias("_x"))
    rows = windows.ewm(rows.withColumn("ret_1d", windows.log_return(c("close"), w)), "symbol", "ts", "_x", 20, 5, "_v")
    short, long = windows.rolling(F.stddev_samp, c("ret_1d"), w, 5, 3), windows.rolling(F.stddev_samp, c("ret_1d"), w, 30, 10)
    usual, spread = windows.rolling(F.avg, c("_v"), w, 90, 30), windows.rolling(F.stddev_samp, c("_v"), w, 90, 30)
    within = lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return rows.select(
        "symbol", "ts", "ret_1d", windows.log_return(c("close"), w, 5).alias("ret_5d"), windows.log_return(c("close"), w, 20).alias("ret_20d"), (long * F.sqrt(F.lit(365.0))).alias("realized_vol_30d"),
        within(F.when(long.isNotNull(), short / F.greatest(long, F.lit(1e-8))), 0.0, 5.0).alias("vol_ratio"), within(F.when(spread.isNotNull(), (c("_v") - usual) / F.greatest(spread, F.lit(1e-8))), -4.0, 4.0).alias("dvol_zscore"),
    )


def trend_flag(reference: DataFrame) -> DataFrame:
    """(ts, flag): whether a reference's close is above its mean of 200 bars; 0 before there are 100."""
    one = reference.select(F.lit(0).alias("g"), "ts", "close")
    mean = windows.rolling(F.avg, F.col("close"), windows.series(["g"], "ts"), 200, 100)
    return one.select("ts", F.coalesce((F.col("close") > mean).cast("double"), F.lit(0.0)).alias(FLAG))


def feature_frame(bars: DataFrame, reference: DataFrame, market: dict[str, DataFrame], own: DataFrame | None = None, clipped: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of ``bars`` (symbol, ts, high, low, close) with OWN, the reference's trend, and series as of the day.

    ``market`` has series (ts, value) that all symbols share, by their names; ``own`` has columns of a symbol's own (symbol,
    ts, ...), of which those ``clipped`` are kept within 0 and 1. A day has the latest row that is not after it, nulls
    stored there included; the last row of a day counts, and before the first there is none. Without a reference's row the
    flag is 0.5. What is sorted is a symbol's history, and the days of all.
    """
    frame = bar_features(bars)
    days = bars.select("ts").distinct().withColumn("g", F.lit(0))
    for name, series in {FLAG: trend_flag(reference), **market}.items():
        right = series.toDF("ts", name).groupBy("ts").agg(F.max(name).alias(name)).withColumn("g", F.lit(0))
        days = windows.as_of(days, right, "g", "ts", [name])
    shared = days.drop("g").withColumn(FLAG, F.coalesce(FLAG, F.lit(0.5)))
    frame = frame.join(F.broadcast(shared), "ts")  # a row per day
    if own is not None:
        columns = [c for c in own.columns if c not in ("symbol", "ts")]
        frame = windows.as_of(frame, own, "symbol", "ts", columns)
        frame = frame.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))) for c in clipped})
    return frame.select("symbol", "ts", *OWN, *[c for c in frame.columns if c not in ("symbol", "ts", *OWN)])


def model_frame(frame: DataFrame, features: list[str], neutral: dict[str, float]) -> DataFrame:
    """``frame`` with its features finite: the last finite value of the symbol, else the feature's neutral value (0 if it has none).

    Adds ``filled``: how many features of the row were not there.
    """
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    finite: dict[str, Column] = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double")) for c in features}
    gone = sum((v.isNull().cast("int") for v in finite.values()), F.lit(0))
    rows = frame.withColumn("filled", gone).withColumns(finite)
    return rows.withColumns({c: F.coalesce(F.last(c, True).over(past), F.lit(float(neutral.get(c, 0.0)))) for c in features})


def coverage(frame: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, feature, n_rows, n_valid, share, first_day, last_day): where each feature of each symbol is there."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)).alias("ok")) for c in features]))
    rows = frame.select("symbol", "ts", each.alias("e")).select("symbol", "ts", "e.*")
    day = F.when(F.col("ok"), F.col("ts"))
    return rows.groupBy("symbol", "feature").agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("n_valid"), F.avg(F.col("ok").cast("int")).alias("share"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
