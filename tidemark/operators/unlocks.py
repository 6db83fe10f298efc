"""Token unlock features: pressure, insider shares, proxies, state ladder, quality rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bucket

#: Weights of the buckets; others weigh nothing.
WEIGHTS = {"Team/Founders": 1.5, "VC/Investors": 1.2, "Ecosystem": 0.8, "Airdrop/Public": 0.6}
INSIDERS = ("Team/Founders", "VC/Investors")


def weight(name: Column, other: float | None = None) -> Column:
    out = F.lit(other).cast("double")
    for k, v in WEIGHTS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def pressure(as_of: DataFrame, events: DataFrame, days: int = 30) -> DataFrame:
    """Weighted unlocks over supply in (as_of, as_of + days]; null where supply is not above 0.

    An interval join by day blocks: an event meets at most the as-of dates of its own block and the one before.
    """
    block = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    left = as_of.withColumn("_b", F.explode(F.array(block(F.col("as_of")), block(F.col("as_of")) + 1)))
    daily = events.groupBy("asset", "event_date", "raw_label").agg(F.sum("tokens").alias("tokens"))
    daily = daily.withColumn("_w", weight(bucket(F.col("raw_label"))) * F.col("tokens")).where("_w is not null").groupBy("asset", "event_date").agg(F.sum("_w").alias("_w"))
    right = daily.withColumn("_b", block(F.col("event_date")))
    gap = F.datediff("event_date", "as_of")
    met = left.join(right, ["asset", "_b"]).where((gap > 0) & (gap <= days)).groupBy("asset", "as_of").agg(F.sum("_w").alias("_w"))
    return as_of.join(met, ["asset", "as_of"], "left").select("asset", "as_of", F.when(F.col("circ") > 0, F.coalesce("_w", F.lit(0.0)) / F.col("circ")).alias("ups_raw"))


def insider_share(events: DataFrame) -> DataFrame:
    name = bucket(F.col("raw_label"))
    daily = events.groupBy("asset", "raw_label").agg(F.sum(F.greatest("tokens", F.lit(0.0))).alias("t"))  # few labels: rules run once for each
    rows = daily.select("asset", name.alias("b"), "t")
    known, inside = F.sum(F.when(F.col("b").isin(*WEIGHTS), F.col("t"))), F.sum(F.when(F.col("b").isin(*INSIDERS), F.col("t")))
    other = F.coalesce(F.sum(F.when(F.col("b") == "Other", F.col("t"))), F.lit(0.0))
    return rows.groupBy("asset").agg(F.try_divide(F.coalesce(inside, F.lit(0.0)), known).alias("insider_share"), F.when(F.sum("t") > 0, other / F.sum("t")).otherwise(0.0).alias("unknown_ratio"))


def proxy_fallback(cap: Column, volume: Column, insider: Column) -> Column:
    return F.sqrt(F.try_divide(cap, volume)) * (1 + insider)


def proxy_full(total: Column, circ: Column, cap: Column, volume: Column, insider: Column) -> Column:
    return F.log1p(F.try_divide(F.greatest(total - circ, F.lit(0.0)), circ)) * proxy_fallback(cap, volume, insider)


def state(observed: Column, rebuilt: Column, full: Column, fallback: Column) -> Column:
    return F.when(observed.isNotNull(), "OBSERVED").when(rebuilt.isNotNull(), "RECONSTRUCTED").when(full.isNotNull(), "PROXY_FULL").when(fallback.isNotNull(), "PROXY_FALLBACK").otherwise("MISSING")


def best_capture(captures: DataFrame, key: str, at: str, mime: str, last_day: Column) -> DataFrame:
    """The row per key to read as of a day: of those not after it, the latest day's, HTML before other kinds, then the latest."""
    seen = captures.where(F.to_date(at) <= last_day)
    html = F.coalesce(F.lower(mime).contains("html"), F.lit(False)).cast("int")
    rest = [c for c in captures.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.to_date(at), html, F.col(at))).alias("_r")).select(key, "_r.*")
