"""Market-panel views over the test tables, and loaders with the panel's null and key rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the last in ``order``; pre-aggregated, so that a hot key costs no window."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with missing columns filled; where keys meet, the new row stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, F.col("_new")).drop("_new")


def ohlcv(ticks: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Bars of ``ticks`` (price, quantity, amount) per key."""
    return ticks.groupBy(*keys).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("amount").alias("quote_volume"),
        F.count("*").alias("n_trades"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.to_date("l_shipdate").alias("ts"),
        (F.lit(100.0) + F.lit(10.0) * unit / (unit + F.lit(2000.0))).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )
    return ohlcv(ticks, ["symbol", "ts"], F.col("at"))


def bars_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.window("ts", "4 hours")["start"].alias("ts"),
        (F.lit(100.0) + F.lit(10.0) * F.col("value") / (F.col("value") + F.lit(50.0))).alias("price"),
        F.lit(1.0).alias("quantity"),
        F.col("value").alias("amount"),
        F.col("ts").alias("at"),
    )
    return ohlcv(ticks, ["symbol", "ts"], F.col("at"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pnl = ((cust * 53 + key * 17) % 2001 - 1000) / F.lit(10000.0)
    base = table(spark, sf_dir, "orders").select(
        key.alias("row_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderstatus").alias("cluster"),
        ((key * 37 % 1000) / F.lit(1000.0)).alias("score"),
        pnl.alias("pnl"),
        ((key * 91 % 1000) / F.lit(1000.0)).alias("regime"),
        F.lit(100.0).alias("p0"),
        (F.lit(500.0) * (key % 9)).alias("position"),
    )
    label = F.when(F.col("pnl") < -0.03, -1).when(F.col("pnl") > 0.03, 1).otherwise(0)
    base = base.withColumn("label", label)
    return base.withColumn("slippage", F.when(F.col("label") == -1, (F.col("row_id") % 40) / F.lit(100.0)).otherwise(F.lit(0.0)))


def unlock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey", F.to_date("l_shipdate").alias("event_date"), F.col("l_quantity").alias("tokens"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    label = F.create_map(*[F.lit(x) for kv in UNLOCK_LABELS.items() for x in kv])
    joined = items.join(parts, "l_partkey")
    return joined.select((F.col("k") % 20).alias("asset"), "event_date", F.coalesce(F.try_element_at(label, F.col("p_type")), F.lit("mystery tranche")).alias("raw_label"), "tokens")


def unlock_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per asset and month, with the asset's supply."""
    assets = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("asset")).distinct()
    month = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2000-12-01").cast("date"), F.expr("interval 1 month")))
    return assets.select("asset", month.alias("as_of"), (F.lit(1000.0) + F.col("asset") * 100).alias("circ"))


#: What the part types stand for.
UNLOCK_LABELS = {"ECONOMY": "core contributors", "STANDARD": "seed sale", "PROMO": "foundation reserve", "SMALL": "public sale", "MEDIUM": "private round", "LARGE": "ecosystem fund"}


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("portfolio"),
        key.alias("arrival"),
        (F.floor(key / 7) + (key * 13 % 5)).cast("long").alias("revision"),
        (F.col("o_custkey") % 3).alias("fingerprint"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("age_days"),
        (key % 29 == 0).alias("expired"),
        F.when(key % 31 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("A"))).alias("instruments"),
    )


def bridge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and retries in one order of arrival, with what the venue reports of each."""
    at = F.col("arrival")
    outcome = F.when(at % 7 < 3, "deferred_not_ready").when(at % 7 == 3, "failed").when(at % 7 == 4, "noop_band").otherwise("submitted")
    return targets(spark, sf_dir).withColumn("kind", F.when(at % 5 == 0, "retry").otherwise("target")).withColumn("outcome", outcome)


# The same views in DuckDB SQL, for the oracles.
BARS = """bars as (
  select symbol, ts, arg_min(price, pos) "open", max(price) high, min(price) low, arg_max(price, pos) "close", sum(quantity) volume, sum(amount) quote_volume, count(*) n_trades
  from (select l_returnflag || l_linestatus symbol, cast(l_shipdate as date) ts, l_quantity quantity, l_extendedprice amount,
               100.0::double + 10.0::double * (l_extendedprice / l_quantity) / (l_extendedprice / l_quantity + 2000.0::double) price,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey) pos from lineitem) group by symbol, ts)"""
BARS4 = """bars4 as (
  select symbol, ts, arg_min(price, pos) "open", max(price) high, min(price) low, arg_max(price, pos) "close", sum(quantity) volume, sum(amount) quote_volume, count(*) n_trades
  from (select event_type symbol, time_bucket(interval 4 hours, events.ts, timestamp '1970-01-01') ts, events.ts pos, 1.0::double quantity, value amount,
               100.0::double + 10.0::double * value / (value + 50.0::double) price from events) group by symbol, ts)"""
TRADES = """trades as (
  select *, case when label = -1 then (row_id % 40) / 100.0::double else 0.0::double end slippage from (
    select *, case when pnl < -0.03::double then -1 when pnl > 0.03::double then 1 else 0 end label from (
      select o_orderkey row_id, cast(o_orderdate as date) "date", o_orderpriority symbol, o_orderstatus "cluster", (o_orderkey * 37 % 1000) / 1000.0::double score,
             ((o_custkey * 53 + o_orderkey * 17) % 2001 - 1000) / 10000.0::double pnl, (o_orderkey * 91 % 1000) / 1000.0::double regime, 100.0::double p0, 500.0::double * (o_orderkey % 9) "position" from orders)))"""
UNLOCKS = """unlocks as (
  select l_suppkey % 20 asset, cast(l_shipdate as date) event_date, l_quantity tokens,
         case p_type when 'ECONOMY' then 'core contributors' when 'STANDARD' then 'seed sale' when 'PROMO' then 'foundation reserve' when 'SMALL' then 'public sale' when 'MEDIUM' then 'private round'
                     when 'LARGE' then 'ecosystem fund' else 'mystery tranche' end raw_label
  from lineitem join part on l_partkey = p_partkey)"""
AS_OF = """as_of as (
  select asset, cast(m as date) as_of, 1000.0::double + asset * 100 circ
  from (select distinct s_suppkey % 20 asset from supplier), (select unnest(generate_series(date '1996-01-01', date '2000-12-01', interval 1 month)) m))"""
TARGETS = """targets as (
  select o_orderstatus portfolio, o_orderkey arrival, cast(o_orderkey // 7 + o_orderkey * 13 % 5 as bigint) revision, o_custkey % 3 fingerprint, date_diff('day', cast(o_orderdate as date), date '2002-01-01') age_days,
         o_orderkey % 29 = 0 expired, case when o_orderkey % 31 = 0 then ['A'] else ['B', 'A'] end instruments from orders)"""
EVENTS = TARGETS + """, events as (
  select *, case when arrival % 5 = 0 then 'retry' else 'target' end kind,
         case when arrival % 7 < 3 then 'deferred_not_ready' when arrival % 7 = 3 then 'failed' when arrival % 7 = 4 then 'noop_band' else 'submitted' end outcome from targets)"""
