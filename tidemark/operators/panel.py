"""Aggregates over trade panels: buckets, errors of calibration, drift, equity curves, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running_path


def trade_buckets(df: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    """Mean gain and mean loss (absolute), 0.02 where there are none, at least 1e-6."""
    gain, loss = F.avg(F.when(F.col(pnl) > 0, F.col(pnl))), F.abs(F.avg(F.when(F.col(pnl) < 0, F.col(pnl))))
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.02)), F.lit(1e-6))
    return df.groupBy(*keys).agg(floor(gain).alias("avg_tp"), floor(loss).alias("avg_sl"))


def symbol_trade_stats(df: DataFrame, pnl: str = "pnl") -> DataFrame:
    """Gains and losses per symbol; a symbol without one takes that of all symbols."""
    one = df.groupBy("symbol").agg(F.avg(F.when(F.col(pnl) > 0, F.col(pnl))).alias("g"), F.abs(F.avg(F.when(F.col(pnl) < 0, F.col(pnl)))).alias("l"))
    everyone = trade_buckets(df, [], pnl)  # one row
    joined = one.join(F.broadcast(everyone))
    return joined.select("symbol", F.greatest(F.coalesce("g", "avg_tp"), F.lit(1e-6)).alias("avg_tp"), F.greatest(F.coalesce("l", "avg_sl"), F.lit(1e-6)).alias("avg_sl"))


def reliability(df: DataFrame, p: str, y: Column, bins: int, closed: bool) -> DataFrame:
    """Rows, mean probability and hit rate per bin; the last bin is open on the right unless ``closed``."""
    at = F.floor(F.col(p) * bins)
    at = F.least(at, F.lit(bins - 1)) if closed else F.when(at < bins, at)
    return df.withColumn("bin", at.cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("hit_rate"))


def calibration_error(df: DataFrame, p: str, y: Column, bins: int, closed: bool) -> DataFrame:
    """Expected calibration error; open bins leave p = 1 out of the sum and in the count."""
    table = reliability(df, p, y, bins, closed)
    part = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mean_p") - F.col("hit_rate")))
    return table.agg(F.try_divide(F.sum(part), F.sum("n")).alias("ece"))


def psi(df: DataFrame, x: str, early: Column, bins: int = 10) -> DataFrame:
    """Population stability of ``x``: shares of early and late rows in bins of early quantiles; values beyond are left out."""
    edges = df.where(early).agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("edges")).withColumn("edges", F.array_distinct("edges"))
    rows = df.withColumn("_early", early).join(F.broadcast(edges))  # one row of edges
    n = F.size("edges")
    inside = (F.col(x) >= F.element_at("edges", 1)) & (F.col(x) <= F.element_at("edges", -1))
    at = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(x))), F.lit(1))
    counts = rows.where(inside).groupBy(F.least(at, n - 1).alias("bin")).agg(F.count_if("_early").alias("e"), F.count_if(~F.col("_early")).alias("l"))
    share = counts.select((F.col("e") / F.sum("e").over(Window.partitionBy())).alias("e"), (F.col("l") / F.sum("l").over(Window.partitionBy())).alias("l"))  # a row per bin
    return share.agg(F.sum((F.col("l") + 1e-6 - F.col("e") - 1e-6) * F.ln((F.col("l") + 1e-6) / (F.col("e") + 1e-6))).alias("psi"))


def equity(df: DataFrame, keys: list[str], order: list[str], ret: str) -> DataFrame:
    """Adds equity (compounded returns), peak and drawdown along ``order`` in each group."""
    df = running_path(df.withColumn("_log", F.ln(1 + F.col(ret))), keys, [F.col(c) for c in order], "_log", "_level", "_top")
    df = df.withColumns({"equity": F.exp("_level"), "peak": F.exp("_top")}).drop("_log", "_level", "_top")
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def portfolio_returns(df: DataFrame, threshold: float, capital: float = 200000.0) -> DataFrame:
    """Trades above the threshold with the share of capital they bind and the return they bring."""
    alloc = F.least(F.greatest(F.col("position") / capital, F.lit(0.0)), F.lit(0.25))
    active = df.where(F.col("score") > threshold).withColumn("alloc", alloc).where("alloc > 0.001")
    return active.withColumn("ret", F.greatest(F.least(F.col("pnl"), F.lit(2.0)), F.lit(-0.5)) * F.col("alloc"))


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
