"""Trade panels: buckets, calibration, drift, policies, equity, sizing, gates, streams in batch form."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import sizing
from tidemark.operators import information, panel, policy, selection, windows
from tidemark.plans.register import registry
from tidemark.sources.views import EVENTS, TARGETS, TRADES, bridge_events, table, targets, trades
from tidemark.streaming import acceptance, bridge

query, QUERIES, ORACLES = registry()
R = lambda c, name, n=6: F.round(c, n).alias(name)
T = f"with {TRADES} "


@query(T + """select symbol, round(greatest(coalesce(avg(pnl) filter (pnl > 0), 0.02), 1e-6), 6) avg_tp, round(greatest(coalesce(abs(avg(pnl) filter (pnl < 0)), 0.02), 1e-6), 6) avg_sl from trades group by symbol""")
def trade_buckets(spark, sf):
    return panel.trade_buckets(trades(spark, sf), ["symbol"]).select("symbol", R(F.col("avg_tp"), "avg_tp"), R(F.col("avg_sl"), "avg_sl"))


@query(T + """, g as (select avg(pnl) filter (pnl > 0) tp, abs(avg(pnl) filter (pnl < 0)) sl from trades),
  s as (select symbol, avg(pnl) filter (pnl > 0) tp, abs(avg(pnl) filter (pnl < 0)) sl from trades where row_id % 2 = 0 or symbol <> '1-URGENT' group by symbol)
  select symbol, round(greatest(coalesce(tp, (select tp from g)), 1e-6), 6) avg_tp, round(greatest(coalesce(sl, (select sl from g)), 1e-6), 6) avg_sl from (select symbol, avg(pnl) filter (pnl > 0) tp, abs(avg(pnl) filter (pnl < 0)) sl from trades group by symbol)""")
def symbol_trade_stats(spark, sf):
    return panel.symbol_trade_stats(trades(spark, sf)).select("symbol", R(F.col("avg_tp"), "avg_tp"), R(F.col("avg_sl"), "avg_sl"))


@query(T + """select row_id, (("label" = 1) or pnl > 0)::int target from trades""")
def meta_target(spark, sf):
    return trades(spark, sf).select("row_id", ((F.col("label") == 1) | (F.col("pnl") > 0)).cast("int").alias("target"))


@query(T + """select row_id, round(case when score <= 0.51 or pnl <= 0 then 0 else least(0.25 * pnl / greatest(regime * regime, 1e-8), 0.08) end, 6) kelly from trades""")
def kelly_ceiling(spark, sf):
    k = F.least(0.25 * F.col("pnl") / F.greatest(F.col("regime") * F.col("regime"), F.lit(1e-8)), F.lit(0.08))
    return trades(spark, sf).select("row_id", R(F.when((F.col("score") <= 0.51) | (F.col("pnl") <= 0), 0.0).otherwise(k), "kelly"))


@query()
def kelly_fraction(spark, sf):
    return trades(spark, sf).select("row_id", R(sizing.kelly_fraction(F.col("pnl"), F.col("regime"), F.col("score")), "kelly"))


@query(T + """select row_id, round(case when "position" <= 0 then 1 else greatest(0, 1 - least(greatest(1 - (3000 + 100000 * pnl) / "position", 0), 1) / 0.18) end, 6) scalar from trades""")
def drawdown_scalar(spark, sf):
    return trades(spark, sf).select("row_id", R(sizing.drawdown_scalar(3000 + 100000 * F.col("pnl"), F.col("position")), "scalar"))


@query(T + """select row_id, round(case when "position" > 0 then least(slippage * sqrt("position" / 2000), 0.5) else slippage end, 6) slippage from trades""")
def slippage_rescale(spark, sf):
    return trades(spark, sf).select("row_id", R(sizing.rescale_slippage(F.col("slippage"), F.col("position"), 2000.0), "slippage"))


@query(T + """select row_id, round(case when "label" = -1 and slippage > 0 and "position" > 0 then 90 * (1 - least(slippage * sqrt("position" / 10000), 0.5)) / p0 - 1 else pnl end, 6) pnl_exec from trades""")
def exec_pnl(spark, sf):
    c = F.col
    return trades(spark, sf).select("row_id", R(sizing.execution_pnl(c("pnl"), c("label"), c("slippage"), c("position"), F.lit(90.0), c("p0"), 10000.0), "pnl_exec"))


@query(T + """select row_id, round(case when "label" = -1 and slippage > 0 then 90 * (1 - least(slippage * 2, 0.5)) / p0 - 1 else pnl end - case when "position" > 0 then 0.001 else 0 end, 6) pnl_stress from trades""")
def friction_stress(spark, sf):
    c = F.col
    return trades(spark, sf).select("row_id", R(sizing.friction_pnl(c("pnl"), c("label"), c("slippage"), c("position"), F.lit(90.0), c("p0"), 2.0, 10.0), "pnl_stress"))


@query(T + """, r as (select symbol, pnl, row_number() over (partition by symbol order by "date" desc, row_id desc) k, count(*) over (partition by symbol) n from trades),
  m as (select min(n) n from r), p as (select k, sum(pnl) pnl from r, m where k <= m.n group by k having count(*) = (select count(distinct symbol) from trades)),
  o as (select pnl, row_number() over (order by pnl, k) i, count(*) over () n from p)
  select round(-avg(pnl), 6) cvar, count(*) n_tail from o where i <= greatest(1, cast(floor(n * 0.05) as int))""")
def cvar_historical_tail(spark, sf):
    """Mean loss of the worst twentieth of joint outcomes, the symbols' trades aligned from the last one back."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("row_id"))
    rows = trades(spark, sf).select("symbol", "pnl", F.row_number().over(w).alias("k"))
    symbols = rows.select("symbol").distinct().count()
    joint = rows.groupBy("k").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n")).where(F.col("n") == symbols)
    n = joint.count()
    return joint.orderBy("pnl", "k").limit(max(1, int(n * 0.05))).agg(R(-F.avg("pnl"), "cvar"), F.count("*").alias("n_tail"))


@query(T + """select round(sum(w * s) * 2.062712807507104, 6) cvar from (select symbol, sum("position") / 200000 / count(*) w, stddev_samp(pnl) s from trades group by symbol)""")
def cvar_stress(spark, sf):
    one = trades(spark, sf).groupBy("symbol").agg((F.sum("position") / 200000 / F.count("*")).alias("w"), F.stddev_samp("pnl").alias("s"))
    return one.agg(R(F.sum(F.col("w") * F.col("s")) * 2.062712807507104, "cvar"))  # the normal density at the 5 % point over 5 %


def _ece(bins, closed):
    at = f"least(floor(score * {bins}), {bins - 1})" if closed else f"case when floor(score * {bins}) < {bins} then floor(score * {bins}) end"
    sql = T + f""", b as (select {at} b, count(*) n, avg(score) p, avg((pnl > 0)::int) h from trades group by 1) select round(sum(case when b is not null then n * abs(p - h) end) / sum(n), 6) ece from b"""
    return sql, lambda spark, sf: panel.calibration_error(trades(spark, sf), "score", F.col("pnl") > 0, bins, closed).select(R(F.col("ece"), "ece"))


for _name, _bins, _closed in (("ece_10_open", 10, False), ("ece_10_closed", 10, True), ("ece_15", 15, False)):
    ORACLES[_name], QUERIES[_name] = _ece(_bins, _closed)


@query(T + """select cast(least(floor(score * 10), 9) as int) bin, count(*) n, round(avg(score), 6) mean_p, round(avg((pnl > 0)::int), 6) hit_rate from trades group by 1""")
def reliability_table(spark, sf):
    return panel.reliability(trades(spark, sf), "score", F.col("pnl") > 0, 10, True).select("bin", "n", R(F.col("mean_p"), "mean_p"), R(F.col("hit_rate"), "hit_rate"))


@query(T + """, e as (select unnest(list_distinct(quantile_cont(pnl, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) q from trades where "date" < date '1999-01-01'),
  es as (select list(q order by q) q from e), c as (select least(greatest(len(list_filter(q, lambda x: x < pnl)), 1), len(q) - 1) b, count(*) filter ("date" < date '1999-01-01') e, count(*) filter ("date" >= date '1999-01-01') l
  from trades, es where pnl between q[1] and q[-1] group by 1), s as (select e / sum(e) over () e, l / sum(l) over () l from c)
  select round(sum((l - e) * ln((l + 1e-6) / (e + 1e-6))), 6) psi from s""")
def psi_early_late(spark, sf):
    return panel.psi(trades(spark, sf), "pnl", F.col("date") < F.lit("1999-01-01").cast("date")).select(R(F.col("psi"), "psi"))


@query("""select event_type, count(*) n, round(avg((value is not null)::int), 6) coverage, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) iqr from events group by event_type""")
def coverage_profile(spark, sf):
    q = lambda p: F.percentile("value", F.lit(p))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), R(F.avg(F.col("value").isNotNull().cast("int")), "coverage"), R(q(0.5), "median"), R(q(0.75) - q(0.25), "iqr"))


@query(T + """select round(corr(score, pnl), 6) score_pnl, round(corr(score, regime), 6) score_regime, round(corr(pnl, regime), 6) pnl_regime from trades""")
def pairwise_corr(spark, sf):
    return trades(spark, sf).agg(*[R(F.corr(a, b), f"{a}_{b}") for a, b in (("score", "pnl"), ("score", "regime"), ("pnl", "regime"))])


@query(T + """select symbol, round(max(n) / sum(n), 6) tie_fraction, count(*) n_unique from (select symbol, pnl, count(*) n from trades group by 1, 2) group by symbol""")
def tie_fraction(spark, sf):
    return trades(spark, sf).groupBy("symbol", "pnl").agg(F.count("*").alias("n")).groupBy("symbol").agg(R(F.max("n") / F.sum("n"), "tie_fraction"), F.count("*").alias("n_unique"))


@query(T + """select case when score < 0.5 then '<0.50' when score < 0.6 then '0.50-0.60' when score < 0.65 then '0.60-0.65' when score < 0.7 then '0.65-0.70' when score < 0.8 then '0.70-0.80' when score > 0.8 then '>0.80' end bucket,
  count(*) n, count(distinct symbol) n_symbols, round(avg(pnl), 6) mean_pnl, round(avg((pnl > 0)::int), 6) win_rate, round(quantile_cont(pnl, 0.5), 6) median_pnl from trades where score <> 0.8 group by 1""")
def score_buckets(spark, sf):
    """Diagnostics per score bucket; a score of exactly 0.80 is in none."""
    bucket = F.lit(None).cast("string")
    for edge, name in ((0.8, "0.70-0.80"), (0.7, "0.65-0.70"), (0.65, "0.60-0.65"), (0.6, "0.50-0.60"), (0.5, "<0.50")):
        bucket = F.when(F.col("score") < edge, name).otherwise(bucket)
    df = trades(spark, sf).withColumn("bucket", F.when(F.col("score") > 0.8, ">0.80").otherwise(bucket)).where("bucket is not null")
    return df.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"), R(F.avg("pnl"), "mean_pnl"), R(F.avg((F.col("pnl") > 0).cast("int")), "win_rate"), R(F.percentile("pnl", F.lit(0.5)), "median_pnl"))


PERIODS = (("early", "1995-01-01", "1996-06-30"), ("rise", "1996-07-01", "1997-12-31"), ("fall", "1998-01-01", "1999-06-30"), ("late", "1999-07-01", "2002-12-31"))
_PERIOD_SQL = " union all ".join(f"select '{n}' period, date '{a}' a, date '{b}' b" for n, a, b in PERIODS)


@query(T + f""", p as ({_PERIOD_SQL}), r as (select period, greatest(least(pnl, 2), -0.5) * least(greatest("position" / 200000, 0), 0.25) r from trades join p on "date" between a and b where score > 0.6 and "position" / 200000 > 0.001)
  select period, count(*) n, round(exp(sum(ln(1 + r))) - 1, 5) cum_return, round(avg(r) / (stddev_pop(r) + 1e-10) * sqrt(50.4), 5) sharpe from r group by period""")
def subperiods(spark, sf):
    period = F.lit(None).cast("string")
    for name, a, b in PERIODS:
        period = F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(period)
    rows = panel.portfolio_returns(trades(spark, sf), 0.6).withColumn("period", period).where("period is not null")
    return rows.groupBy("period").agg(F.count("*").alias("n"), R(F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1, "cum_return", 5), R(F.avg("ret") / (F.stddev_pop("ret") + 1e-10) * F.sqrt(F.lit(50.4)), "sharpe", 5))


@query(T + """select "date", symbol, round(avg(score), 6) p_meta, arg_min("cluster", row_id) "cluster", count(*) n_paths from trades group by 1, 2""")
def oos_aggregate(spark, sf):
    return trades(spark, sf).groupBy("date", "symbol").agg(R(F.avg("score"), "p_meta"), F.min_by("cluster", "row_id").alias("cluster"), F.count("*").alias("n_paths"))


@query(T + """select symbol, row_id, score, case when "position" > 0 then 'BUY' else 'FLAT' end side from (select *, row_number() over (partition by symbol order by "date" desc, row_id desc) r from trades) where r = 1""")
def execution_snapshot(spark, sf):
    return panel.latest(trades(spark, sf), "symbol", F.struct("date", "row_id")).select("symbol", "row_id", "score", F.when(F.col("position") > 0, "BUY").otherwise("FLAT").alias("side"))


@query(T + """, c as (select count(*) n_rows, count(*) filter (score > 0.8) n_signal, count(*) filter (score > 0.8 and "position" > 0) n_sized, count(*) filter (score > 0.8 and "position" / 200000 > 0.01) n_alloc from trades)
  select *, case when n_signal = 0 then 'signal' when n_sized = 0 then 'sizing' when n_alloc = 0 then 'allocation' else 'none' end choke from c""")
def activation_funnel(spark, sf):
    signal = F.col("score") > 0.8
    c = trades(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if(signal).alias("n_signal"), F.count_if(signal & (F.col("position") > 0)).alias("n_sized"), F.count_if(signal & (F.col("position") / 200000 > 0.01)).alias("n_alloc"))
    return c.withColumn("choke", F.when(F.col("n_signal") == 0, "signal").when(F.col("n_sized") == 0, "sizing").when(F.col("n_alloc") == 0, "allocation").otherwise("none"))


@query(T + """select row_id, score from (select *, row_number() over (partition by "date" order by score desc, row_id) r from trades where score > 0.6 and regime >= 0.5) where r <= 1""")
def policy_topn_regime(spark, sf):
    return policy.top_per_day(trades(spark, sf).where("score > 0.6 and regime >= 0.5"), "date", "score", "row_id", 1).select("row_id", "score")


@query(T + """select row_id, score from (select *, row_number() over (partition by "date" order by score desc, row_id) r from trades where score > 0.6) where r <= least(5, cast(floor(0.02 / 0.01 + 1e-12) as int))""")
def policy_daily_cap(spark, sf):
    return policy.top_per_day(trades(spark, sf).where("score > 0.6"), "date", "score", "row_id", min(5, int(0.02 / 0.01 + 1e-12))).select("row_id", "score")


@query(f"""with recursive {TRADES}, q as (select symbol, row_id, date_diff('day', date '1970-01-01', "date") d, row_number() over (partition by symbol order by "date", row_id) k from trades where score > 0.9),
  f(symbol, k, last, kept, row_id) as (select symbol, k, d, true, row_id from q where k = 1 union all
    select q.symbol, q.k, case when q.d - f.last > 3 then q.d else f.last end, q.d - f.last > 3, q.row_id from f join q on q.symbol = f.symbol and q.k = f.k + 1)
  select row_id, symbol from f where kept""")
def policy_cooldown(spark, sf):
    return policy.cooldown(trades(spark, sf).where("score > 0.9"), "symbol", "date", "row_id", 3).select("row_id", "symbol")


EQUITY = T + """, r as (select symbol, "date", row_id, greatest(least(pnl, 2), -0.5) * least(greatest("position" / 200000, 0), 0.25) ret from trades where score > 0.6 and least(greatest("position" / 200000, 0), 0.25) > 0.001),
  e as (select *, exp(sum(ln(1 + ret)) over (partition by symbol order by "date", row_id rows between unbounded preceding and current row)) equity from r),
  d as (select *, equity / greatest(max(equity) over (partition by symbol order by "date", row_id rows between unbounded preceding and current row), 1) - 1 drawdown from e)"""


def _equity(spark, sf):
    return panel.equity(panel.portfolio_returns(trades(spark, sf), 0.6), ["symbol"], ["date", "row_id"], "ret")


@query(EQUITY + " select symbol, row_id, round(equity, 6) equity from d")
def equity_curve(spark, sf):
    return _equity(spark, sf).select("symbol", "row_id", R(F.col("equity"), "equity"))


@query(EQUITY + " select symbol, round(min(drawdown), 6) max_drawdown, count(*) n from d group by symbol")
def max_drawdown(spark, sf):
    return _equity(spark, sf).groupBy("symbol").agg(R(F.min("drawdown"), "max_drawdown"), F.count("*").alias("n"))


@query(T + """, r as (select "date", pnl * 0.1 ret from trades where score > 0.6), b as (select min("date") a, max("date") z from r),
  w as (select cast(unnest(generate_series(a + interval 365 day, z::timestamp, interval 30 day)) as date) e from b)
  select w.e window_end, count(*) n, round(avg(ret), 6) mean_ret, round(stddev_pop(ret), 6) std_ret from w join r on r."date" > w.e - 365 and r."date" <= w.e group by w.e""")
def rolling_stability(spark, sf):
    """A year's window each 30 days: trades go to the at most 13 window ends that hold them, without a range join."""
    rows = trades(spark, sf).where("score > 0.6").select("date", (F.col("pnl") * 0.1).alias("ret"))
    span = F.broadcast(rows.agg(F.min("date").alias("a"), F.max("date").alias("z")))  # one row
    daily = rows.groupBy("date").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q")).join(span)
    first = F.greatest(F.lit(0), F.ceil((F.datediff("date", "a") - 365) / 30).cast("int"))
    last = F.floor((F.least(F.datediff("date", "a") - 1, F.datediff("z", "a") - 365)) / 30).cast("int")
    fits = F.transform(F.sequence(first, first + 12), lambda k: F.date_add("a", (k * 30 + 365).cast("int")))
    ends = F.filter(fits, lambda e: (F.col("date") > F.date_sub(e, 365)) & (F.col("date") <= e) & (e <= F.col("z")))
    each = daily.select(F.explode(ends).alias("window_end"), "n", "s", "q").groupBy("window_end").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return each.select("window_end", "n", R(mean, "mean_ret"), R(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), "std_ret"))


@query(T + """, d as (select list(distinct "date" order by "date") d from trades), s as (select d, greatest(cast(floor(len(d) * 0.1) as int), 90) z from d), k as (select unnest(range(4)) k)
  select cast(k as int) fold, d[252 + k * z] train_end, d[252 + k * z + 1] test_start, d[252 + k * z + z] test_end from s, k where 252 + k * z + z <= len(d)""")
def forward_folds(spark, sf):
    return policy.forward_folds(trades(spark, sf), "date")


@query(T + """, d as (select "date", dense_rank() over (order by "date") r from trades), c as (select *, max(r) over () n from d)
  select case when r > n - greatest(cast(ceil(n * 0.2) as int), 90) then 'holdout' else 'train' end part, count(*) n, min("date") first_day, max("date") last_day from c group by 1""")
def holdout_split(spark, sf):
    days = trades(spark, sf).groupBy("date").agg(F.count("*").alias("k"))
    ranked = days.withColumn("r", F.row_number().over(Window.orderBy("date"))).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row per day
    part = F.when(F.col("r") > F.col("n") - F.greatest(F.ceil(F.col("n") * 0.2), F.lit(90)), "holdout").otherwise("train")
    return ranked.groupBy(part.alias("part")).agg(F.sum("k").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


STAGE = T + """, t as (select *, 0.02::double avg_sl, pnl > 0.02 ok, case when pnl > 0.02 then pnl / 0.02 end ratio from trades),
  c as (select *, count(*) filter (ok) over (partition by "date", "cluster") n, row_number() over (partition by "date", "cluster" order by ratio desc nulls last, symbol, row_id) l, row_number() over (partition by "date" order by ratio desc nulls last, symbol, row_id) g from t)"""


@query(STAGE + " select row_id, (ok and ((n >= 2 and l = 1) or (n = 1 and g = 1)))::int target, (n >= 2)::int \"local\" from c")
def stage_top1_local_fallback(spark, sf):
    return policy.relative_target(trades(spark, sf).withColumn("avg_sl", F.lit(0.02))).select("row_id", "target", "local")


@query(T + """, g as (select quantile_cont(pnl, 0.6) q from trades where pnl > 0) select "cluster", round(case when count(*) filter (pnl > 0) >= 50 then quantile_cont(case when pnl > 0 then pnl end, 0.6) else (select q from g) end, 6) threshold from trades group by "cluster" """)
def cluster_quantile_threshold(spark, sf):
    df = trades(spark, sf)
    pos = F.when(F.col("pnl") > 0, F.col("pnl"))
    whole = F.broadcast(df.agg(F.percentile(pos, F.lit(0.6)).alias("g")))  # one row
    own = df.groupBy("cluster").agg(F.percentile(pos, F.lit(0.6)).alias("q"), F.count(pos).alias("n"))
    return own.join(whole).select("cluster", R(F.when(F.col("n") >= 50, F.col("q")).otherwise(F.col("g")), "threshold"))


@query(T + """, r as (select "date", row_number() over (partition by "date" order by pnl desc, row_id) truth, row_number() over (partition by "date" order by score desc, row_id) guess, count(*) over (partition by "date") n from trades)
  select round(avg((guess = 1)::int), 6) hit_rate, round(avg(1.0 / guess), 6) mrr, count(*) n_contests from r where truth = 1 and n >= 2""")
def ranking_hit_rate_mrr(spark, sf):
    day = Window.partitionBy("date")
    r = trades(spark, sf).select(F.row_number().over(day.orderBy(F.desc("pnl"), "row_id")).alias("truth"), F.row_number().over(day.orderBy(F.desc("score"), "row_id")).alias("guess"), F.count("*").over(day).alias("n"))
    return r.where("truth = 1 and n >= 2").agg(R(F.avg((F.col("guess") == 1).cast("int")), "hit_rate"), R(F.avg(1 / F.col("guess")), "mrr"), F.count("*").alias("n_contests"))


@query(T + """, v as (select score, count(*) n, count(*) filter (pnl > 0) p from trades group by score), r as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 k from v)
  select round((sum(k * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p)::double * (sum(n) - sum(p))), 6) auc from r""")
def auc_rank_sum(spark, sf):
    return information.auc(trades(spark, sf), "score", F.col("pnl") > 0, []).select(R(F.col("auc"), "auc"))


@query(T + """, v as (select symbol, score, count(*) n, count(*) filter (pnl > 0) p from trades group by 1, 2), r as (select *, coalesce(sum(n) over (partition by symbol order by score rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 k from v)
  select symbol, round((sum(k * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p)::double * (sum(n) - sum(p))), 6) auc from r group by symbol""")
def auc_by_symbol(spark, sf):
    return information.auc(trades(spark, sf), "score", F.col("pnl") > 0, ["symbol"]).select("symbol", R(F.col("auc"), "auc"))


BINS = T + """, e as (select quantile_cont(score, [.2, .4, .6, .8]) s, quantile_cont(pnl, [.2, .4, .6, .8]) p, quantile_cont(regime, [.2, .4, .6, .8]) r from trades),
  b as (select row_id, len(list_filter(e.s, lambda x: x <= score)) score_bin, len(list_filter(e.p, lambda x: x <= pnl)) pnl_bin, len(list_filter(e.r, lambda x: x <= regime)) regime_bin from trades, e)"""


def _bins(spark, sf):
    return information.quantile_bins(trades(spark, sf), ["score", "pnl", "regime"], 5)


@query(BINS + " select row_id, score_bin::int score_bin, pnl_bin::int pnl_bin, regime_bin::int regime_bin from b")
def discretize_quantile(spark, sf):
    return _bins(spark, sf).select("row_id", "score_bin", "pnl_bin", "regime_bin")


@query(BINS + ", c as (select count(*)::double n from b group by score_bin, pnl_bin), p as (select n / sum(n) over () p from c) select round(-sum(p * log2(p + 1e-12)), 6) bits from p")
def entropy_bits(spark, sf):
    return information.entropy(_bins(spark, sf), ["score_bin", "pnl_bin"]).select(R(F.col("bits"), "bits"))


@query(BINS + """, c as (select 'score_bin' a, 'pnl_bin' b, score_bin x, pnl_bin y from b union all select 'score_bin', 'regime_bin', score_bin, regime_bin from b union all select 'pnl_bin', 'regime_bin', pnl_bin, regime_bin from b),
  j as (select a, b, x, y, count(*) / sum(count(*)) over (partition by a, b) p from c group by 1, 2, 3, 4), m as (select *, sum(p) over (partition by a, b, x) px, sum(p) over (partition by a, b, y) py from j)
  select a, b, round((-sum(p * log2(p)) - sum(p * log2(p / (px * py)))) / -sum(p * log2(p)), 6) vi from m group by a, b""")
def vi_matrix(spark, sf):
    return information.vi_matrix(_bins(spark, sf), ["score_bin", "pnl_bin", "regime_bin"]).select("a", "b", R(F.col("vi"), "vi"))


CLUSTERS = (("score", "a"), ("regime", "a"), ("slippage", "b"), ("position", "b"), ("label", "c"))
_CLUSTER_SQL = ", ".join(f"('{f}', '{c}')" for f, c in CLUSTERS)
CHOSEN = f""", cl(feature, "cluster") as (values {_CLUSTER_SQL}), ch as (
  select * from (select s.*, "cluster", row_number() over (partition by "cluster" order by strength desc nulls last, feature) r from s join cl using (feature)) where r = 1 and strength is not null)
  select feature, "cluster", round(strength, 6) strength, row_number() over (order by strength desc, feature)::int place from ch"""


def _chosen(spark, strengths):
    named = spark.createDataFrame(CLUSTERS, "feature string, cluster string")
    return selection.best_per_cluster(strengths, named).withColumn("strength", F.round("strength", 6))


@query(T + """, x as (select row_id, (pnl > 0)::int::double y, unnest(['score', 'regime', 'slippage', 'position', 'label']) feature, unnest([score, regime, slippage, "position", "label"::double]) v from trades),
  e as (select feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q from x group by feature), b as (select feature, y, len(list_filter(q, lambda z: z <= v)) b from x join e using (feature)),
  c as (select feature, b, y, count(*) c from b group by all), p as (select *, sum(c) over (partition by feature) n, sum(c) over (partition by feature, b) nb, sum(c) over (partition by feature, y) ny from c),
  s as (select feature, greatest(sum(c / n * log2(c * n / (nb * ny))), 0) strength from p group by feature)""" + CHOSEN)
def mi_best_per_cluster(spark, sf):
    """Of each cluster of features the one that shares most information with winning."""
    df = trades(spark, sf).withColumn("y", (F.col("pnl") > 0).cast("int"))
    return _chosen(spark, selection.shared_information(df, [f for f, _ in CLUSTERS], "y"))


@query(T + """, x as (select row_id, pnl y, unnest(['score', 'regime', 'slippage', 'position', 'label']) feature, unnest([score, regime, slippage, "position", "label"::double]) v from trades),
  r as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 rv, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 ry from x),
  s as (select feature, abs(corr(rv, ry)) strength from r group by feature)""" + CHOSEN)
def rank_best_per_cluster(spark, sf):
    """Of each cluster of features the one whose ranks follow the outcome's most."""
    return _chosen(spark, selection.rank_correlation(trades(spark, sf), [f for f, _ in CLUSTERS], "pnl"))


@query(T + """, p as (select row_id, row_number() over (order by "date", symbol, row_id) - 1 pos, count(*) over () n from trades), f as (select *, least(pos // (n // 5), 4) fold, greatest(1, cast(floor(n * 0.01) as int)) e from p)
  select row_id, pos::int pos, fold::int fold, n - (least(case when fold = 4 then n else (fold + 1) * (n // 5) end + e, n) - greatest(fold * (n // 5) - e, 0)) n_train from f""")
def purged_kfold_assign(spark, sf):
    return policy.purged_folds(trades(spark, sf), 5, 0.01)


@query(T + """, p as (select row_number() over (order by "date", symbol, row_id) - 1 pos, count(*) over () n from trades), g as (select least(pos // (n // 6), 5) g from p),
  c as (select a.k a, b.k b from (select unnest(range(6)) k) a, (select unnest(range(6)) k) b where a.k < b.k)
  select a::int a, b::int b, count(*) n_test from c join g on g.g = a or g.g = b group by 1, 2""")
def cpcv_paths_15(spark, sf):
    """The 15 pairs of six groups that are tested together, with their rows."""
    groups = policy.purged_folds(trades(spark, sf), 6, 0.01).groupBy("fold").agg(F.count("*").alias("n"))
    one = groups.agg(F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("n"))  # six entries
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(6) for b in range(a + 1, 6)])
    return one.select("n", F.explode(pairs).alias("p")).select("p.a", "p.b", (F.element_at("n", F.col("p.a")) + F.element_at("n", F.col("p.b"))).alias("n_test"))


MANAGED = ("A", "B")
ACCEPT = f"with {TARGETS}" + """, v as (select *, case when expired or age_days > 2400 then 'stale' when list_sort(list_distinct(instruments)) <> ['A', 'B'] then 'incomplete' end away from targets),
  p as (select *, max(revision) over (partition by portfolio order by arrival rows between unbounded preceding and 1 preceding) before from v where away is null),
  q as (select *, first_value(fingerprint) over (partition by portfolio, revision order by arrival) first_fp from p),
  s as (select portfolio, arrival, revision, case when before is null or revision > before then 'accepted' when revision < before then 'out_of_order' when fingerprint = first_fp then 'duplicate' else 'conflict' end status from q
    union all select portfolio, arrival, revision, away from v where away is not null)"""


@query(ACCEPT + " select * from s")
def accept_ladder(spark, sf):
    return acceptance.ladder(targets(spark, sf), 2400, MANAGED)


@query(ACCEPT + " select portfolio, status, min(arrival) first_arrival, count(*) n from s group by 1, 2")
def status_dedup(spark, sf):
    return acceptance.ladder(targets(spark, sf), 2400, MANAGED).groupBy("portfolio", "status").agg(F.min("arrival").alias("first_arrival"), F.count("*").alias("n"))


@query(f"with {TARGETS} select portfolio, count(*) n, count(*) filter (age_days > 2400) n_stale from targets group by portfolio")
def staleness(spark, sf):
    return targets(spark, sf).groupBy("portfolio").agg(F.count("*").alias("n"), F.count_if(F.col("age_days") > 2400).alias("n_stale"))


@query()
def stream_accept(spark, sf):
    return acceptance.stream(targets(spark, sf), 2400, MANAGED)


BRIDGE = f"with {EVENTS}" + """, v as (select *, case when expired or age_days > 2400 then 'rejected_stale' when list_sort(list_distinct(instruments)) <> ['A', 'B'] then 'rejected_incomplete_snapshot' end away from events where kind = 'target'),
  p as (select *, max(revision) over (partition by portfolio order by arrival rows between unbounded preceding and 1 preceding) before, first_value(fingerprint) over (partition by portfolio, revision order by arrival) first_fp from v where away is null),
  judged as (
    select portfolio, arrival, revision, outcome, case when before is null or revision > before then 'accepted' when revision < before then 'rejected_out_of_order' when fingerprint = first_fp then 'rejected_duplicate' else 'rejected_revision_conflict' end verdict from p
    union all select portfolio, arrival, revision, outcome, away from v where away is not null),
  acc as (select *, lead(arrival) over (partition by portfolio order by arrival) later from judged where verdict = 'accepted' and outcome <> 'failed'),
  slots as (select portfolio, arrival message, revision, later from acc where outcome = 'deferred_not_ready'),
  tries as (
    select s.portfolio, s.message, e.arrival, s.revision,
           case when exists (select 1 from judged j where j.portfolio = s.portfolio and j.verdict = 'accepted' and j.arrival > s.message and j.arrival < e.arrival) then 'rejected_superseded' else e.outcome end status
    from slots s join events e on e.kind = 'retry' and e.portfolio = s.portfolio and e.arrival > s.message and (s.later is null or e.arrival < s.later)),
  acts as (
    select * from (select *, count(*) filter (status in ('submitted', 'noop_band', 'rejected_superseded')) over (partition by portfolio, message order by arrival rows between unbounded preceding and 1 preceding) done from tries) where done = 0),
  ends as (select portfolio, message, min(arrival) ended from acts where status <> 'deferred_not_ready' group by 1, 2),
  late as (select s.portfolio, s.message, s.revision from slots s left join ends using (portfolio, message) where (ended is null or ended > s.message + 40) and s.message + 40 < (select max(arrival) from events)),
  statuses as (
    select portfolio, arrival message, arrival, 0 seq, revision, 'received' status from judged
    union all select portfolio, arrival, arrival, 1, revision, verdict from judged
    union all select portfolio, arrival, arrival, 2, revision, outcome from judged where verdict = 'accepted'
    union all select portfolio, message, arrival, 0, revision, status from acts
    union all select portfolio, message, message, 9, revision, 'timeout_waiting_terminal_status' from late)"""
PATIENCE = 40


@query(BRIDGE + " select * from statuses")
def bridge_statuses(spark, sf):
    """Every status of every target: acceptance, deferral, retries, supersession and deadlines."""
    return bridge.statuses(bridge_events(spark, sf), 2400, MANAGED, PATIENCE)


@query(BRIDGE + """, applied as (
    select portfolio, arrival, revision from judged where verdict = 'accepted' and outcome in ('submitted', 'noop_band') union all select portfolio, arrival, revision from acts where status in ('submitted', 'noop_band')),
  held as (
    select portfolio, revision deferred from slots s where later is null and not exists (select 1 from acts a where a.portfolio = s.portfolio and a.message = s.message and a.status in ('submitted', 'noop_band', 'rejected_superseded')))
  select j.portfolio, max(revision) filter (verdict = 'accepted') last_accepted, (select arg_max(revision, arrival) from applied a where a.portfolio = j.portfolio) last_applied,
         (select max(deferred) from held h where h.portfolio = j.portfolio) deferred, max(arrival) filter (verdict <> 'accepted' or outcome <> 'failed') "cursor" from judged j group by j.portfolio""")
def bridge_state(spark, sf):
    return bridge.final_state(bridge_events(spark, sf), 2400, MANAGED)


@query(BRIDGE + """, m as (select portfolio, message, list(status order by arrival, seq) s from (select portfolio, message, status, min(arrival) arrival, arg_min(seq, (arrival, seq)) seq from statuses group by 1, 2, 3) group by 1, 2),
  r as (select *, coalesce(list_filter(s, lambda x: x like 'rejected!_%' escape '!' or x = 'failed')[1], case when list_has_any(s, ['submitted', 'noop_band']) then null else 'timeout_waiting_terminal_status' end) reason from m)
  select portfolio, message, reason is null success, reason, array_to_string(s, ',') statuses from r""")
def message_results(spark, sf):
    rows = bridge.statuses(bridge_events(spark, sf), 2400, MANAGED, PATIENCE)
    return bridge.message_results(rows, ["portfolio", "message"], ["arrival", "seq"]).withColumn("statuses", F.array_join("statuses", ","))


@query()
def bridge_stream(spark, sf):
    """The same statuses from the stream."""
    return bridge.replay(bridge_events(spark, sf), 2400, MANAGED, PATIENCE)


@query("""with t as (select s_suppkey k, (s_suppkey % 4) * 0.01::double w, case when s_suppkey % 5 = 0 then null else 90 + s_suppkey % 20 end::double px, case when s_suppkey % 3 = 0 then 0 else s_suppkey * 10 end::double qty from supplier),
  d as (select *, 100000 * w goal, coalesce(qty, 0) * px held from t)
  select k, case when px is null then 'no_price' when w = 0 and qty = 0 then 'already_flat' when w = 0 and held < 200 then 'dust_close' when w = 0 then 'close' when abs(goal - held) <= 100000 * 0.0025 then 'noop_band' when abs(goal - held) < 500 then 'min_notional' when goal > held then 'buy' else 'sell' end intent,
         round(case when px is not null then goal - held end, 4) delta from d""")
def reconcile_intents(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("k"), ((k % 4) * F.lit(0.01)).alias("weight"), F.when(k % 5 != 0, 90 + k % 20).cast("double").alias("price"), F.when(k % 3 == 0, 0).otherwise(k * 10).cast("double").alias("quantity"))
    return acceptance.reconcile(rows, nav=100000.0, band=0.0025, dust=200.0, least=500.0).select("k", "intent", R(F.col("delta"), "delta", 4))


# States of each customer's book: every rule of the checks has rows of its own.
STATES = """select c_custkey k, (c_custkey % 13) / 100.0 + case when c_custkey % 17 = 0 then 0.1 else 0 end dd, case when c_custkey % 19 = 0 then 0.0 else (c_custkey % 9 + 1) / 9.0 end scalar,
  case when c_custkey % 23 = 0 then 0.25 else (c_custkey % 19) / 100.0 end cvar, c_custkey % 29 = 0 systemic, c_custkey % 5 <> 0 bull, case when c_custkey % 7 = 0 then 'BLOCKED' else 'OPEN' end breaker,
  case c_custkey % 11 when 1 then 'SEVERE' when 2 then 'MODERATE' else 'NONE' end drift, 0.40 + (c_custkey % 14) / 100.0 auc from customer"""


def _states(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("k"),
        ((k % 13) / 100 + F.when(k % 17 == 0, 0.1).otherwise(0.0)).alias("dd"),
        F.when(k % 19 == 0, 0.0).otherwise((k % 9 + 1) / 9).alias("scalar"),
        F.when(k % 23 == 0, 0.25).otherwise((k % 19) / 100).alias("cvar"),
        (k % 29 == 0).alias("systemic"),
        (k % 5 != 0).alias("bull"),
        F.when(k % 7 == 0, "BLOCKED").otherwise("OPEN").alias("breaker"),
        F.when(k % 11 == 1, "SEVERE").when(k % 11 == 2, "MODERATE").otherwise("NONE").alias("drift"),
        (F.lit(0.40) + (k % 14) / 100).alias("auc"),
    )


@query(f"""with c as ({STATES}) select k, case when scalar = 0 or cvar > 0.20 or systemic then 3 when not bull or breaker = 'BLOCKED' or drift in ('MODERATE', 'SEVERE') then 2
  when scalar < 0.75 or cvar between 0.15 and 0.18 or auc > 0.52 then 1 else 0 end level from c""")
def alarm_level(spark, sf):
    return _states(spark, sf).select("k", sizing.alarm_level(*[F.col(c) for c in ("scalar", "cvar", "systemic", "bull", "breaker", "drift", "auc")]).alias("level"))


@query(f"""with c as ({STATES}), r as (select *, case when dd >= 0.18 then 'drawdown' when cvar > 0.20 then 'cvar' when systemic then 'systemic_drift' end halt,
    case when not bull then 'bear' when breaker = 'BLOCKED' then 'spread_breaker' when drift = 'SEVERE' then 'severe_drift' end block, case when drift = 'MODERATE' then 'moderate_drift' when dd > 0.09 then 'drawdown_warning' end warn from c)
  select k, halt is null and block is null approved, case when halt is not null then 3 when block is not null then 2 when warn is not null then 1 else 0 end level, coalesce(halt, block, warn, 'ok') reason,
         round(case when halt is null and block is null then 1000 * scalar * case when cvar > 0.15 then 0.15 / cvar else 1 end else 0 end, 4)::double size from r""")
def pre_trade_size(spark, sf):
    check = sizing.pre_trade(*[F.col(c) for c in ("dd", "cvar", "systemic", "bull", "breaker", "drift")], F.lit(1000.0), F.col("scalar"))
    return _states(spark, sf).select("k", check.alias("c")).select("k", "c.approved", "c.level", "c.reason", R(F.col("c.size"), "size", 4))


@query(T + """, r as (select greatest(least(pnl, 2), -0.5) * least(greatest("position" / 200000, 0), 0.25) ret, pnl, score from trades where score > 0.6 and "position" > 200)
  select 'sharpe' metric, round(avg(ret) / (stddev_pop(ret) + 1e-10) * sqrt(50.4), 5) "value", case when avg(ret) / (stddev_pop(ret) + 1e-10) * sqrt(50.4) >= 0.5 then 'PASS' else 'FAIL' end verdict from r
  union all select 'win_rate', round(avg((pnl > 0)::int), 5), case when avg((pnl > 0)::int) > 0.5 then 'PASS' else 'FAIL' end from r""")
def gate_verdicts(spark, sf):
    one = panel.portfolio_returns(trades(spark, sf), 0.6).agg((F.avg("ret") / (F.stddev_pop("ret") + 1e-10) * F.sqrt(F.lit(50.4))).alias("sharpe"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"))
    rows = F.array(F.struct(F.lit("sharpe").alias("metric"), F.col("sharpe").alias("value"), (F.col("sharpe") >= 0.5).alias("ok")), F.struct(F.lit("win_rate").alias("metric"), F.col("win_rate").alias("value"), (F.col("win_rate") > 0.5).alias("ok")))
    return one.select(F.explode(rows).alias("g")).select("g.metric", R(F.col("g.value"), "value", 5), F.when(F.col("g.ok"), "PASS").otherwise("FAIL").alias("verdict"))


@query("""with c as (select s_suppkey k, s_name name, s_acctbal cap from supplier where s_nationkey % 5 <> 0 and s_acctbal > 0), p as (select quantile_cont(cap, 0.75) q from c)
  select k, cap from c where cap <= (select q from p) order by cap desc, k limit 20""")
def universe_topn_filter(spark, sf):
    rows = table(spark, sf, "supplier").where("s_nationkey % 5 <> 0 and s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("cap"))
    bound = F.broadcast(rows.agg(F.percentile("cap", F.lit(0.75)).alias("q")))  # one row
    return rows.join(bound).where("cap <= q").orderBy(F.desc("cap"), "k").limit(20).select("k", "cap")


@query("""select m k from (select unnest([1, 2, 3, 9999]) m) where m not in (select s_suppkey from supplier)""")
def mandatory_anti_join(spark, sf):
    must = spark.createDataFrame([(1,), (2,), (3,), (9999,)], "k int")
    return must.join(table(spark, sf, "supplier"), F.col("k") == F.col("s_suppkey"), "left_anti")
