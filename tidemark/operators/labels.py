"""Event labels: first touch of barriers, overlap of label intervals, sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def market_impact(order: Column, volume: Column, sigma: Column, eta: float = 0.1) -> Column:
    """Square-root impact, at most one half."""
    return F.least(F.lit(max(eta, 0.05)) * F.greatest(sigma, F.lit(0.0)) * F.sqrt(F.greatest(order, F.lit(0.0)) / F.greatest(volume, F.lit(1e-10))), F.lit(0.5))


def triple_barrier(bars: DataFrame, sigma: str, most: int = 5, k_tp: float = 1.5, k_sl: float = 1.5, order_size: float = 10000.0, eta: float = 0.1) -> DataFrame:
    """First touch of a stop or a target within the holding limit, for every bar with a positive ``sigma``.

    ``bars``: symbol, ts, high, low, close, quote_volume, range_vol and ``sigma``. The limit is shorter for lively
    markets. A bar that touches both counts as stopped; the bars ahead come from a bounded frame, not from a join.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = F.collect_list(F.struct("ts", "high", "low", "close", "quote_volume", "range_vol")).over(w.rowsBetween(1, most))
    s = F.round(sigma, 9)
    hold = F.greatest(F.lit(2), F.least(F.lit(most), F.bround(F.lit(float(most)) * F.greatest(F.lit(0.5), F.least(F.lit(1.25), F.lit(0.03) / s))).cast("int")))
    df = bars.withColumn("_ahead", ahead).where(F.col(sigma) > 0).withColumn("_hold", hold)
    df = df.withColumn("_bars", F.slice("_ahead", 1, F.col("_hold"))).withColumn("_sl", F.col("close") * (1 - k_sl * s)).withColumn("_tp", F.col("close") * (1 + k_tp * s))
    hits = F.filter("_bars", lambda b: (b["low"] <= F.col("_sl")) | (b["high"] >= F.col("_tp")))
    df = df.withColumn("_hit", F.try_element_at(hits, F.lit(1))).withColumn("_last", F.try_element_at("_bars", F.lit(-1)))
    stopped = F.coalesce(F.col("_hit.low") <= F.col("_sl"), F.lit(False))
    impact = market_impact(F.lit(order_size), F.col("_hit.quote_volume"), F.col("_hit.range_vol"), eta)
    label = F.when(F.col("_hit").isNull(), 0).when(stopped, -1).otherwise(1)
    out = F.when(F.col("_hit").isNull(), F.coalesce(F.col("_last.close"), F.col("close"))).when(stopped, F.col("_sl") * (1 - F.coalesce(impact, F.lit(0.0)))).otherwise(F.col("_tp"))
    df = df.withColumn("label", label).withColumn("exit_price", out).withColumn("t_touch", F.coalesce("_hit.ts", "_last.ts", "ts"))
    return df.select(
        "symbol", F.col("ts").alias("event_date"), "t_touch", "label", F.col("_hold").alias("holding_limit"), F.col("_tp").alias("barrier_tp"), F.col("_sl").alias("barrier_sl"),
        "exit_price", (F.col("exit_price") / F.col("close") - 1).alias("pnl_real"), s.alias("sigma_at_entry"), F.col("close").alias("p0"),
    )


def uniqueness(events: DataFrame) -> DataFrame:
    """Adds concurrency, the closed label intervals of the symbol that meet each one, and uniqueness, 1 over it.

    Intervals that meet [t0, t1] are those begun by t1 less those ended before t0: two running counts over days.
    """
    starts = events.groupBy("symbol", F.col("event_date").alias("day")).agg(F.count("*").alias("n_start"))
    ends = events.groupBy("symbol", F.col("t_touch").alias("day")).agg(F.count("*").alias("n_end"))
    days = starts.join(ends, ["symbol", "day"], "full").na.fill(0, ["n_start", "n_end"])
    w = Window.partitionBy("symbol").orderBy("day")
    counted = days.select("symbol", "day", F.sum("n_start").over(w).alias("begun"), (F.sum("n_end").over(w) - F.col("n_end")).alias("ended"))
    by_end = counted.select("symbol", F.col("day").alias("t_touch"), "begun")
    by_start = counted.select("symbol", F.col("day").alias("event_date"), "ended")
    out = events.join(by_end, ["symbol", "t_touch"]).join(by_start, ["symbol", "event_date"])
    both = F.col("begun") - F.col("ended")
    return out.withColumn("concurrency", both).withColumn("uniqueness", 1 / F.greatest(both, F.lit(1))).drop("begun", "ended").select(*events.columns, "concurrency", "uniqueness")


def sample_weight(days_ago: Column, unique: Column, label: Column, keys: list[str], life: float = 180.0, penalty: float = 2.0) -> Column:
    """Uniqueness, decayed by exp(-days/life), stops counting double, with a mean of 1 per group."""
    raw = unique * F.exp(-days_ago / life) * F.when(label == -1, penalty).otherwise(1.0)
    return raw / F.avg(raw).over(Window.partitionBy(*keys))
