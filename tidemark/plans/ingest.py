"""Ingest parsers, universe rules, ladders of the feature layers, audits and stores."""

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import labels
from tidemark.plans.register import registry
from tidemark.sources.folders import scratch
from tidemark.sources.views import TRADES, keep_last, table, trades, upsert
from tidemark.streaming import bridge

query, QUERIES, ORACLES = registry()
R = lambda c, name, n=6: F.round(c, n).alias(name)
T = f"with {TRADES} "


@query("""select user_id, ts, o, c, v from (select user_id, event_id % 50 ts, 100.0::double + event_id % 7 o, 100.0::double + value c, value v, row_number() over (partition by user_id, event_id % 50 order by event_id desc) r from events) where r = 1""")
def klines_parse(spark, sf):
    """Positional arrays in JSON text to typed bars, the last of a time kept."""
    raw = F.concat(F.lit("["), (F.col("event_id") % 50).cast("string"), F.lit(',"'), (100 + F.col("event_id") % 7).cast("string"), F.lit('","'), (F.lit(100.0) + F.col("value")).cast("string"), F.lit('","'), F.col("value").cast("string"), F.lit('"]'))
    rows = table(spark, sf, "events").select("user_id", "event_id", F.from_json(raw, "array<string>").alias("k"))
    bars = rows.select("user_id", "event_id", *[F.get("k", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate((("ts", "long"), ("o", "double"), ("c", "double"), ("v", "double")))])
    return keep_last(bars, ["user_id", "ts"], F.col("event_id")).drop("event_id")


@query("""with p as (select s_suppkey k, s_acctbal price from supplier where s_suppkey % 2 = 0), c as (select s_suppkey k, 1000.0::double * s_suppkey cap from supplier where s_suppkey % 3 = 0), v as (select s_suppkey k, 5.0::double vol from supplier where s_suppkey % 5 = 0)
  select coalesce(p.k, c.k, v.k) k, price, cap, vol, round(case when cap > 0 and price > 0 then cap / price end, 6) circ from p full join c on p.k = c.k full join v on coalesce(p.k, c.k) = v.k""")
def market_chart_merge(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    p, c, v = s.where("k % 2 = 0").select("k", F.col("s_acctbal").alias("price")), s.where("k % 3 = 0").select("k", (1000.0 * F.col("k")).alias("cap")), s.where("k % 5 = 0").select("k", F.lit(5.0).alias("vol"))
    rows = p.join(c, "k", "full").join(v, "k", "full")
    return rows.select("k", "price", "cap", "vol", R(F.when((F.col("cap") > 0) & (F.col("price") > 0), F.col("cap") / F.col("price")), "circ"))


@query("""select c_custkey k, coalesce(case when c_custkey % 3 = 0 then 100.0::double end, case when c_acctbal > 0 then round(c_acctbal / 7, 6) end) circulating, case when c_custkey % 2 = 0 then 500.0::double else 900.0::double end total from customer""")
def normalize_market_row(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    given, total, most = F.when(k % 3 == 0, 100.0), F.when(k % 2 == 0, 500.0), F.lit(900.0)
    return table(spark, sf, "customer").select(k.alias("k"), F.coalesce(given, F.when(bal > 0, F.round(bal / 7, 6))).alias("circulating"), F.coalesce(total, most).alias("total"))


#: Ways in which a balance is written: as it is, padded, as text that is no number, or not at all.
NUMBERS = ("%v", " %v ", "%ve0", "-", "", "nan", "inf", "%v USD", None)


@query(f"""select s_suppkey k, case when s_suppkey % {len(NUMBERS)} < 3 then s_acctbal end x from supplier""")
def safe_float(spark, sf):
    form = F.element_at(F.array(*[F.lit(x) for x in NUMBERS]), (F.col("s_suppkey") % len(NUMBERS) + 1).cast("int"))
    raw = F.replace(form, F.lit("%v"), F.col("s_acctbal").cast("decimal(18,2)").cast("string"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), text.safe_float(raw).alias("x"))


@query("""select p_partkey k, rtrim(rtrim(cast(cast(p_retailprice as decimal(18, 6)) as varchar), '0'), '.') plain from part""")
def decimal_string(spark, sf):
    s = F.col("p_retailprice").cast("decimal(18,6)").cast("string")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "").alias("plain"))


@query("""select s_suppkey k, round(0.35 * src + 0.20 * parse + 0.20 * 0.5 + 0.15 * supply + 0.10 * timely, 6)::double confidence, case when timely = 0 then 'look_ahead' when 0.35 * src + 0.20 * parse + 0.20 * 0.5 + 0.15 * supply + 0.10 * timely >= 0.85 then 'promote' when
  0.35 * src + 0.20 * parse + 0.20 * 0.5 + 0.15 * supply + 0.10 * timely >= 0.70 then 'evidence' else 'drop' end decision
  from (select s_suppkey, (s_suppkey % 2)::double src, (s_suppkey % 4) / 3.0::double parse, (s_suppkey % 5 > 0)::int::double supply, (s_suppkey % 7 > 0)::int::double timely from supplier)""")
def reconstruction_confidence(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("k"), (k % 2).cast("double").alias("src"), ((k % 4) / 3).alias("parse"), (k % 5 > 0).cast("double").alias("supply"), (k % 7 > 0).cast("double").alias("timely"))
    c = 0.35 * F.col("src") + 0.20 * F.col("parse") + F.lit(0.20 * 0.5) + 0.15 * F.col("supply") + 0.10 * F.col("timely")
    decision = F.when(F.col("timely") == 0, "look_ahead").when(F.round(c, 9) >= 0.85, "promote").when(F.round(c, 9) >= 0.70, "evidence").otherwise("drop")
    return rows.select("k", R(c, "confidence"), decision.alias("decision"))


SYMBOLS = ["BTC", "usdt", "LINK", "EURS", "steth", "SOL", "aUSD", "ADA"]


@query(f"""with c as (select p_partkey k, ({SYMBOLS})[p_partkey % 8 + 1] symbol, p_name || case when p_partkey % 9 = 0 then ' Bridged' else '' end name from part)
  select k, symbol from c where not (upper(symbol) in ('BTC', 'ETH', 'USDT', 'USDC', 'BUSD', 'TUSD', 'DAI', 'FDUSD', 'PYUSD', 'USDD', 'FRAX', 'GUSD', 'USDP', 'WBTC', 'WETH', 'STETH', 'CBETH', 'RETH')
    or regexp_matches(upper(symbol), 'USD|EUR|GBP|JPY') or regexp_matches(upper(name), 'STABLECOIN|PEGGED|BRIDGED'))""")
def stablecoin_filter(spark, sf):
    k = F.col("p_partkey")
    symbol = F.element_at(F.array(*[F.lit(x) for x in SYMBOLS]), (k % 8 + 1).cast("int"))
    coins = table(spark, sf, "part").select(k.alias("k"), symbol.alias("symbol"), F.concat("p_name", F.when(k % 9 == 0, " Bridged").otherwise("")).alias("name"))
    return coins.where(~text.is_stablecoin(F.col("symbol"), F.col("name"))).select("k", "symbol")


@query("""select c_custkey k, floor(date_diff('day', date '2015-01-01' + cast(c_custkey as int), date '2024-01-01') / 30)::int "months" from customer""")
def age_months(spark, sf):
    born = F.date_add(F.lit("2015-01-01").cast("date"), F.col("c_custkey").cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.datediff(F.lit("2024-01-01").cast("date"), born) / 30).cast("int").alias("months"))


@query("""with a as (select distinct o_orderpriority symbol from orders where o_orderkey % 2 = 0), b as (select distinct o_orderpriority symbol from orders where o_custkey % 97 = 0), x as (select '5-LOW' symbol)
  select symbol, a.symbol is not null features, b.symbol is not null meta, x.symbol is not null excluded, case when b.symbol is not null and x.symbol is not null then 'FAIL' when b.symbol is null and x.symbol is null then 'FAIL' else 'PASS' end verdict
  from a full join b using (symbol) full join x using (symbol)""")
def artifact_audit(spark, sf):
    orders = table(spark, sf, "orders")
    have = lambda cond, name: orders.where(cond).select(F.col("o_orderpriority").alias("symbol")).distinct().withColumn(name, F.lit(True))
    excluded = spark.createDataFrame([("5-LOW", True)], "symbol string, excluded boolean")
    rows = have("o_orderkey % 2 = 0", "features").join(have("o_custkey % 97 = 0", "meta"), "symbol", "full").join(excluded, "symbol", "full").na.fill(False, ["features", "meta", "excluded"])
    return rows.select("symbol", "features", "meta", "excluded", F.when(F.col("meta") == F.col("excluded"), "FAIL").otherwise("PASS").alias("verdict"))


@query("""with d as (select cast(ts as date) "date", count(distinct user_id) n_assets, avg(value) v from events group by 1), m as (select quantile_cont(n_assets, 0.5) med from (select * from d order by "date" desc limit 30))
  select "date", n_assets, round(v, 6) mean_value from d, m where n_assets >= greatest(10, 0.8 * med) order by "date" desc limit 1""")
def latest_operational_row(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct("user_id").alias("n_assets"), R(F.avg("value"), "mean_value"))
    usual = F.broadcast(days.orderBy(F.desc("date")).limit(30).agg(F.percentile("n_assets", F.lit(0.5)).alias("med")))  # one row
    return days.join(usual).where(F.col("n_assets") >= F.greatest(F.lit(10.0), 0.8 * F.col("med"))).orderBy(F.desc("date")).limit(1).select("date", "n_assets", "mean_value")


@query(T + """select year("date")::int "year", count(*) n, count(*) filter (pnl > 0) positives, round(avg((pnl > 0)::int), 6) prevalence from trades group by 1""")
def prevalence_by_year(spark, sf):
    return trades(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("positives"), R(F.avg((F.col("pnl") > 0).cast("int")), "prevalence"))


@query("""select event_type, count(*) filter (value > 80) halt, count(*) filter (value between 50 and 80) block, count(*) filter (value < 50) clear, max(value) worst from events group by event_type order by halt desc, event_type limit 5""")
def alarm_summary(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(v > 80).alias("halt"), F.count_if(v.between(50, 80)).alias("block"), F.count_if(v < 50).alias("clear"), F.max("value").alias("worst"))
    return rows.orderBy(F.desc("halt"), "event_type").limit(5)


@query("""select event_id, event_type, value from events where value > 50 order by ts desc, event_id desc limit 25""")
def alarm_history(spark, sf):
    return table(spark, sf, "events").where("value > 50").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "event_type", "value")


@query("""select o_orderkey k, round(least(greatest(0.1, 0.05) * greatest((o_custkey % 50) / 1000.0::double, 0) * sqrt(o_totalprice / greatest(1000000.0::double, 1e-10)), 0.5), 9) impact from orders""")
def market_impact(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), R(labels.market_impact(F.col("o_totalprice"), F.lit(1e6), (F.col("o_custkey") % 50) / 1000), "impact", 9))


@query("""select l_orderkey k, round(sum(l_extendedprice) / sum(l_quantity), 9) vwap, count(*) fills from lineitem group by 1""")
def fill_vwap(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(R(F.sum("l_extendedprice") / F.sum("l_quantity"), "vwap", 9), F.count("*").alias("fills"))


@query("""select n_name nation, round(sum(s_acctbal * (1 + s_suppkey % 3)) + 1000, 4) nav from supplier join nation on s_nationkey = n_nationkey group by 1""")
def portfolio_nav(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return table(spark, sf, "supplier").join(nations, "s_nationkey").groupBy("nation").agg(R(F.sum(F.col("s_acctbal") * (1 + F.col("s_suppkey") % 3)) + 1000, "nav", 4))


@query(T + """, s as (select symbol, quantile_cont(score, [0.25, 0.5, 0.75]) s, quantile_cont(pnl, [0.25, 0.5, 0.75]) p, avg((slippage > 0)::int) c from trades group by symbol)
  select symbol, round(s[2], 6) score_median, round(s[3] - s[1], 6) score_iqr, round(p[2], 6) pnl_median, round(p[3] - p[1], 6) pnl_iqr, round(c, 6) coverage from s""")
def symbol_signature(spark, sf):
    q = lambda c, p: F.percentile(c, F.lit(p))
    parts = [x for c in ("score", "pnl") for x in (R(q(c, 0.5), f"{c}_median"), R(q(c, 0.75) - q(c, 0.25), f"{c}_iqr"))]
    return trades(spark, sf).groupBy("symbol").agg(*parts, R(F.avg((F.col("slippage") > 0).cast("int")), "coverage"))


@query(T + """, r as (select *, rank() over (partition by "cluster" order by score) + (count(*) over (partition by "cluster", score) - 1) / 2.0::double rs, rank() over (partition by "cluster" order by pnl) + (count(*) over (partition by "cluster", pnl) - 1) / 2.0::double rp from trades)
  select "cluster", round(corr(rs, rp), 6) spearman, count(*) n from r group by "cluster" """)
def spearman_by_cluster(spark, sf):
    """Spearman correlation from average ranks of the distinct values, counted before they are ranked."""
    from pyspark.sql import Window

    df = trades(spark, sf).select("cluster", "score", "pnl")

    def ranks(c):
        n = df.groupBy("cluster", c).agg(F.count("*").alias("n"))
        w = Window.partitionBy("cluster").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return n.select("cluster", c, (F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2).alias(f"r_{c}"))

    return df.join(ranks("score"), ["cluster", "score"]).join(ranks("pnl"), ["cluster", "pnl"]).groupBy("cluster").agg(R(F.corr("r_score", "r_pnl"), "spearman"), F.count("*").alias("n"))


@query("""select c_custkey k, case when c_custkey % 3 = 0 then 'new' else 'old' end tag, c_acctbal v from customer""")
def feature_store_merge(spark, sf):
    """Writes a partitioned zstd table, merges new rows into it by key and reads it again."""
    folder = scratch(spark)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 4).alias("part"))
    rows.withColumn("tag", F.lit("old")).write.partitionBy("part").option("compression", "zstd").parquet(f"{folder}/store")
    merged = upsert(spark.read.parquet(f"{folder}/store"), rows.where("k % 3 = 0").withColumn("tag", F.lit("new")), ["k"])
    merged.write.partitionBy("part").option("compression", "zstd").parquet(f"{folder}/merged")
    return spark.read.parquet(f"{folder}/merged").select("k", "tag", "v")


SIGNAL = """with t as (select o_orderstatus portfolio, o_orderkey k, o_custkey % 6 revision, cast(o_orderdate as date) "day", l_partkey instrument, case when l_linenumber = 7 then -1 else 1 end * l_quantity / 150.0::double w from orders left join lineitem on l_orderkey = o_orderkey),
  g as (select portfolio, k, any_value(revision) revision, any_value("day") "day", count(instrument) n, count(distinct instrument) d, min(w) least, sum(abs(w)) gross from t group by 1, 2)"""


@query(SIGNAL + """ select portfolio, k, problem from (select *, case when n = 0 then 'empty' when d < n then 'duplicate_instrument' when least < 0 then 'negative_weight' when gross > 1.0::double + 1e-6 then 'gross' when "day" < date '1996-01-01' then 'expired' when revision <= 0 then 'revision' end problem from g) where problem is not null""")
def payload_validation(spark, sf):
    """The first broken rule of each order's lines taken as the targets of a signal."""
    c = F.col
    heads = table(spark, sf, "orders").select(c("o_orderstatus").alias("portfolio"), c("o_orderkey").alias("k"), (c("o_custkey") % 6).alias("revision"), F.to_date("o_orderdate").alias("valid_until"))
    lines = table(spark, sf, "lineitem").select(c("l_orderkey").alias("k"), c("l_partkey").alias("instrument"), (F.when(c("l_linenumber") == 7, -1).otherwise(1) * c("l_quantity") / 150.0).alias("weight"))
    return bridge.payload_problems(heads, lines, "k", F.lit("1996-01-01").cast("date")).where("problem is not null").select("portfolio", "k", "problem")
