"""Universes of parts taken as coins, their addresses, and the weighted unlocks of suppliers."""

from pyspark.sql import functions as F

from tidemark.operators import universe
from tidemark.plans.register import registry
from tidemark.sources.views import table

query, QUERIES, ORACLES = registry()
COLLAPSED = [("terra", "LUNA"), ("ftx", "FTT"), ("celsius", "CEL"), ("c7", "C7")]
REFERENCE = [("bitcoin", "BTC"), ("c8", "c8")]
URL_TYPES = ["whitepaper", "docs", "tokenomics", "vesting", "unlocks", "homepage", "litepaper", "blog", "official_forum"]
LIMITS = {"top_n": 150, "volume": 20_000_000.0, "months": 18}


def _coins(spark, sf):
    k = F.col("p_partkey")
    symbol = F.when(k % 9 == 0, "USDT").when(k % 9 == 1, "aUSD").when(k % 9 == 2, "eth").otherwise(F.concat(F.lit("c"), k % 60))
    name = F.concat("p_name", F.when(k % 11 == 0, " Wrapped").when(k % 13 == 0, " (Bridged)").otherwise(""))
    genesis = F.date_add(F.lit("1998-01-01").cast("date"), (k * 37 % 2000).cast("int")).cast("string")
    return table(spark, sf, "part").select(k.alias("id"), symbol.alias("symbol"), name.alias("name"), (F.col("p_retailprice") * (F.col("p_size") + 1)).alias("market_cap"), (F.col("p_retailprice") * 30000 * (k % 4)).alias("volume"), F.when(k % 17 > 0, genesis).alias("genesis"))


def _scores(spark, sf):
    return table(spark, sf, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey") % 40).alias("symbol"), (F.abs("s_acctbal") / 10000).alias("score"))


SQL = """with coins as (
    select p_partkey id, upper(case p_partkey % 9 when 0 then 'USDT' when 1 then 'aUSD' when 2 then 'eth' else 'c' || p_partkey % 60 end) symbol, upper(p_name || case when p_partkey % 11 = 0 then ' Wrapped' when p_partkey % 13 = 0 then ' (Bridged)' else '' end) name,
      p_retailprice * (p_size + 1) cap, p_retailprice * 30000 * (p_partkey % 4) volume, case when p_partkey % 17 > 0 then date_diff('day', date '1998-01-01' + cast(p_partkey * 37 % 2000 as int), date '2003-06-01') // 30 else 0 end age from part),
  top as (select * from coins order by cap desc, id limit 150), sc as (select 'C' || s_suppkey % 40 symbol, max(abs(s_acctbal) / 10000) score from supplier group by 1),
  b as (select top.*, score, case when symbol in ('BTC', 'ETH', 'USDT', 'USDC', 'BUSD', 'TUSD', 'DAI', 'FDUSD', 'PYUSD', 'USDD', 'FRAX', 'GUSD', 'USDP', 'WBTC', 'WETH', 'STETH', 'CBETH', 'RETH') then 'excluded' when regexp_matches(symbol, 'USD|EUR|GBP|JPY') or regexp_matches(name, 'STABLECOIN|PEGGED|BRIDGED') then 'stablecoin'
    when contains(name, 'WRAPPED') then 'wrapped' when volume < 20000000 then 'volume' when age < 18 then 'age' end broken from top left join sc using (symbol)),
  q as (select quantile_cont(score, 0.75) cut from b where broken is null), v as (select b.*, coalesce(broken, case when score > cut then 'unlocks' end, 'kept') verdict from b, q),
  u as (select symbol, cast(id as varchar) id, 'active' "role", score, cap, 0 r from v where verdict = 'kept' union all select upper(s), i, 'collapsed', null, null, 1 from (values ('terra', 'LUNA'), ('ftx', 'FTT'), ('celsius', 'CEL'), ('c7', 'C7')) x(i, s)
    union all select upper(s), i, 'reference', null, null, 2 from (values ('bitcoin', 'BTC'), ('c8', 'c8')) x(i, s)),
  f as (select * from (select *, row_number() over (partition by symbol order by r, cap desc nulls last, id) k from u) where k = 1)"""
DAY = "2003-06-01"


def _universe(spark, sf):
    fixed = lambda rows: spark.createDataFrame(rows, "id string, symbol string")
    return universe.universe(_coins(spark, sf), _scores(spark, sf), fixed(COLLAPSED), fixed(REFERENCE), F.lit(DAY).cast("date"), **LIMITS)


@query(SQL + " select id, symbol, verdict, round(score, 6) score from v")
def universe_verdicts(spark, sf):
    """Why each of the largest coins is in the universe or not."""
    rows = universe.judged(_coins(spark, sf), _scores(spark, sf), F.lit(DAY).cast("date"), **LIMITS)
    return rows.select("id", "symbol", "verdict", F.round("score", 6).alias("score"))


@query(SQL + ' select symbol, id, "role", round(score, 6) score from f')
def universe_point_in_time(spark, sf):
    return _universe(spark, sf).withColumn("score", F.round("score", 6))


@query(SQL + " select m symbol from (select unnest(['LUNA', 'C1', 'C3', 'C59', 'FTT', 'NONE']) m) where m not in (select symbol from f)")
def universe_missing(spark, sf):
    mandatory = spark.createDataFrame([(m,) for m in ("LUNA", "c1", "C3", "C59", "FTT", "NONE")], "symbol string")
    return universe.missing(_universe(spark, sf), mandatory)


@query(f"""with u as (select o_custkey % 50 asset, 'https://example.org/' || o_orderkey % 20 url, ({URL_TYPES + ['other']})[o_orderkey % 10 + 1] url_type, case when o_orderkey % 3 > 0 then o_orderkey % 7 end priority from orders),
  o as (select *, coalesce(list_position({URL_TYPES}, url_type) - 1, 99) t, coalesce(priority, 999) p from u), b as (select * from (select *, row_number() over (partition by asset, url order by t, p, url_type, priority nulls first) k from o) where k = 1),
  r as (select *, row_number() over (partition by asset order by t, p, url) place from b)
  select asset, place::int place, url, url_type, priority from r where place <= 4""")
def reconstruction_urls(spark, sf):
    """The four addresses of each asset to read first."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in [*URL_TYPES, "other"]]), (k % 10 + 1).cast("int"))
    urls = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("asset"), F.concat(F.lit("https://example.org/"), k % 20).alias("url"), kind.alias("url_type"), F.when(k % 3 > 0, k % 7).alias("priority"))
    return universe.best_urls(urls, URL_TYPES, 4)


@query("""select s_suppkey k, round(1.5 * 0.01 * (s_suppkey % 7) + 0.8 * s_acctbal / 100000 + 0.5 * 0.02, 6) score from supplier""")
def unlock_category_score(spark, sf):
    shares = F.create_map(F.lit("Team/Founders"), 0.01 * (F.col("s_suppkey") % 7), F.lit("Ecosystem"), F.col("s_acctbal") / 100000, F.lit("mystery"), F.lit(0.02), F.lit("VC/Investors"), F.lit(None).cast("double"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), universe.unlock_score(shares).alias("score"))
