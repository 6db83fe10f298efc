"""Bars, returns, volatility, spreads, labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import labels, windows
from tidemark.plans.register import registry
from tidemark.sources.views import BARS, BARS4, bars_4h, bars_daily, keep_last, table, upsert

query, QUERIES, ORACLES = registry()
R = lambda c, name, n=6: F.round(c, n).alias(name)


def _w():
    return windows.series(["symbol"], "ts")


ROLL = "partition by symbol order by ts rows between {} preceding and current row"
BAR_COLUMNS = 'symbol, ts, round("open", 6) "open", round(high, 6) high, round(low, 6) low, round("close", 6) "close", round(volume, 4) volume, round(quote_volume, 2) quote_volume, n_trades'


def _bars(df):
    return df.select("symbol", "ts", *[R(F.col(c), c) for c in ("open", "high", "low", "close")], R(F.col("volume"), "volume", 4), R(F.col("quote_volume"), "quote_volume", 2), "n_trades")


@query(f"with {BARS} select {BAR_COLUMNS} from bars")
def bars_daily_ohlcv(spark, sf):
    return _bars(bars_daily(spark, sf))


@query(f"with {BARS4} select {BAR_COLUMNS} from bars4")
def bars_4h_ohlcv(spark, sf):
    return _bars(bars_4h(spark, sf))


@query("""select event_type, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) r from events) where r = 1""")
def keep_last_dedup(spark, sf):
    events = table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id", "value")
    return keep_last(events, ["event_type", "user_id"], F.col("ts"), F.col("event_id")).drop("ts")


@query("""with old as (select s_suppkey k, s_name name from supplier where s_suppkey % 3 <> 0),
  new as (select s_suppkey k, s_acctbal bal from supplier where s_suppkey % 2 = 0)
  select coalesce(new.k, old.k) k, case when new.k is null then name end name, bal from old full join new on old.k = new.k""")
def schema_merge(spark, sf):
    s = table(spark, sf, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return upsert(old, new, ["k"])


@query(f"""with {BARS} select symbol, ts, round(ln("close" / lag("close", 1) over w), 6) + 0.0::double ret_1, round(ln("close" / lag("close", 5) over w), 6) + 0.0::double ret_5, round(ln("close" / lag("close", 20) over w), 6) + 0.0::double ret_20
  from bars window w as (partition by symbol order by ts)""")
def returns_multi_horizon(spark, sf):
    return bars_daily(spark, sf).select("symbol", "ts", *[R(windows.log_return(F.col("close"), _w(), k), f"ret_{k}") for k in (1, 5, 20)])


RET = f"""with {BARS}, ret as (select *, ln("close" / lag("close") over (partition by symbol order by ts)) r from bars)"""


def _returns(spark, sf):
    return bars_daily(spark, sf).withColumn("r", windows.log_return(F.col("close"), _w()))


@query(f"""{RET} select symbol, ts, round(case when count(r) over w >= 10 then stddev_samp(r) over w end * sqrt(365), 6) realized_vol from ret window w as ({ROLL.format(29)})""")
def realized_vol_30(spark, sf):
    return _returns(spark, sf).select("symbol", "ts", R(windows.rolling(F.stddev_samp, F.col("r"), _w(), 30, 10) * F.sqrt(F.lit(365.0)), "realized_vol"))


@query(f"""{RET} select symbol, ts, round(least(greatest(case when count(r) over s >= 3 then stddev_samp(r) over s end / greatest(case when count(r) over l >= 10 then stddev_samp(r) over l end, 1e-8), 0), 5), 6) vol_ratio
  from ret window s as ({ROLL.format(4)}), l as ({ROLL.format(29)})""".replace("round(least(greatest(", "round(case when count(r) over l >= 10 then least(greatest(").replace("0), 5), 6)", "0), 5) end, 6)"))
def vol_ratio(spark, sf):
    short, long = windows.rolling(F.stddev_samp, F.col("r"), _w(), 5, 3), windows.rolling(F.stddev_samp, F.col("r"), _w(), 30, 10)
    ratio = F.when(long.isNotNull(), F.least(F.greatest(short / F.greatest(long, F.lit(1e-8)), F.lit(0.0)), F.lit(5.0)))
    return _returns(spark, sf).select("symbol", "ts", R(ratio, "vol_ratio"))


EWM = """, num as (select *, row_number() over (partition by symbol order by ts) - 1 n from {src}),
  wt as (select *, case when {x} is not null then pow({d}, -n) end w from num),
  cum as (select *, sum(w) over k s0, sum(w * {x}) over k s1, sum(w * {x} * {x}) over k s2, sum(w * w) over k q, count({x}) over k c from wt window k as (partition by symbol order by ts))"""


@query(RET + EWM.format(src="ret", x="r", d="(1 - 2.0::double / 21)") + """
  select symbol, ts, round(case when c >= 5 then sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q), 0)) end, 6) sigma from cum""")
def sigma_ewma(spark, sf):
    return windows.ewm(_returns(spark, sf), "symbol", "ts", "r", 20, 5, "s", std=True).select("symbol", "ts", R(F.col("s"), "sigma"))


@query(f"with {BARS}, rng as (select *, case when high + low <> 0 then (high - low) / ((high + low) / 2) end x from bars)" + EWM.format(src="rng", x="x", d="(1 - 2.0::double / 21)") + """
  select symbol, ts, round(case when c >= 5 then s1 / s0 end, 6) range_vol from cum""")
def range_vol_ewm(spark, sf):
    mid = (F.col("high") + F.col("low")) / 2
    bars = bars_daily(spark, sf).withColumn("x", F.when(mid != 0, (F.col("high") - F.col("low")) / mid))
    return windows.ewm(bars, "symbol", "ts", "x", 20, 5, "v").select("symbol", "ts", R(F.col("v"), "range_vol"))


@query(f"""with {BARS}, rng as (select *, (high - low) / ((high + low) / 2) x from bars)
  select symbol, ts, round(case when count(x) over w >= 30 then least(greatest((x - avg(x) over w) / greatest(stddev_samp(x) over w, 1e-8), -4), 4) end, 6) z from rng window w as ({ROLL.format(89)})""")
def dvol_zscore(spark, sf):
    x = F.col("x")
    bars = bars_daily(spark, sf).withColumn("x", (F.col("high") - F.col("low")) / ((F.col("high") + F.col("low")) / 2))
    z = (x - windows.rolling(F.avg, x, _w(), 90, 30)) / F.greatest(windows.rolling(F.stddev_samp, x, _w(), 90, 30), F.lit(1e-8))
    return bars.select("symbol", "ts", R(F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-4.0)), F.lit(4.0))), "z"))


@query(f"""with {BARS}, flag as (select symbol, ts, coalesce(case when count("close") over w >= 100 and "close" > avg("close") over w then 1.0 end, 0.0)::double f from bars window w as ({ROLL.format(199)})),
  ref as (select ts, f from flag where symbol = 'AF')
  select b.symbol, b.ts, coalesce((select arg_max(f, ref.ts) from ref where ref.ts <= b.ts), 0.5)::double flag from bars b""")
def ma200_flag_asof(spark, sf):
    bars = bars_daily(spark, sf)
    mean = windows.rolling(F.avg, F.col("close"), _w(), 200, 100)
    ref = bars.where("symbol = 'AF'").select(F.lit(1).alias("g"), "ts", F.coalesce(F.when(F.col("close") > mean, 1.0), F.lit(0.0)).alias("f"))
    # one reference series for all: as-of per day, then back to the bars
    days = bars.select(F.lit(1).alias("g"), "ts").distinct()
    flags = windows.as_of(days, ref, "g", "ts", ["f"]).drop("g")
    return bars.join(flags, "ts").select("symbol", "ts", F.coalesce("f", F.lit(0.5)).alias("flag"))


@query("""with d as (select event_type symbol, cast(ts as date) "date", avg(value / 1000) rate from events group by 1, 2)
  select symbol, "date", round(rate, 9) rate, round(avg(rate) over (partition by symbol order by "date" rows between 6 preceding and current row), 9) ma7 from d""")
def funding_daily_ma7(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.avg(F.col("value") / 1000).alias("rate"))
    w = windows.series(["symbol"], "date").rowsBetween(-6, 0)
    return daily.select("symbol", "date", R(F.col("rate"), "rate", 9), R(F.avg("rate").over(w), "ma7", 9))


@query(f"""with {BARS}, spot as (select ts, "close" s from bars where symbol = 'AF'), fut as (select ts, "close" f from bars where symbol = 'RO')
  select spot.ts, round(f / s - 1, 6) basis, case when f is null then 'spot_only' else 'futures' end source from spot left join fut on spot.ts = fut.ts""")
def basis_left_join(spark, sf):
    bars = bars_daily(spark, sf)
    spot, fut = bars.where("symbol = 'AF'").select("ts", F.col("close").alias("s")), bars.where("symbol = 'RO'").select("ts", F.col("close").alias("f"))
    return spot.join(fut, "ts", "left").select("ts", R(F.when(F.col("s") > 0, F.col("f") / F.col("s") - 1), "basis"), F.when(F.col("f").isNull(), "spot_only").otherwise("futures").alias("source"))


@query(f"""with {BARS} select symbol, ts, round(case when lag(quote_volume, 30) over w > 0 then quote_volume / lag(quote_volume, 30) over w - 1 end, 6) chg30 from bars window w as (partition by symbol order by ts)""")
def change_30_rows(spark, sf):
    return bars_daily(spark, sf).select("symbol", "ts", R(windows.change(F.col("quote_volume"), _w(), 30), "chg30"))


SPREAD = f"""with {BARS4}, two as (select *, lag(high) over (partition by symbol order by ts) h0, lag(low) over (partition by symbol order by ts) l0 from bars4),
  b as (select symbol, ts, case when h0 is not null then pow(ln(h0 / l0), 2) + pow(ln(high / low), 2) end beta, pow(ln(greatest(high, h0) / least(low, l0)), 2) gamma, h0 from two),
  a as (select symbol, ts, case when h0 is not null then (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2::double)) - sqrt(gamma / (3 - 2 * sqrt(2::double))) end alpha from b),
  sp as (select symbol, ts, case when alpha is not null then greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) end spread from a)"""


def _spread(spark, sf):
    """Two-bar high/low spread, floored at 0; null on the first bar."""
    k = 3 - 2 * 2**0.5
    h0, l0 = F.lag("high").over(_w()), F.lag("low").over(_w())
    beta = F.pow(F.ln(h0 / l0), 2) + F.pow(F.ln(F.col("high") / F.col("low")), 2)
    gamma = F.pow(F.ln(F.greatest("high", h0) / F.least("low", l0)), 2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    bars = bars_4h(spark, sf).withColumn("alpha", F.when(h0.isNotNull(), alpha))
    return bars.withColumn("spread", F.when(F.col("alpha").isNotNull(), F.greatest(2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha")), F.lit(0.0))))


@query(f"{SPREAD} select symbol, ts, round(spread, 6) spread from sp")
def spread_two_bar(spark, sf):
    return _spread(spark, sf).select("symbol", "ts", R(F.col("spread"), "spread"))


SPREAD_Z = f"""{SPREAD}, z as (select symbol, ts, case when count(spread) over w >= 10 then (spread - avg(spread) over w) / greatest(stddev_samp(spread) over w, 1e-8) end z from sp window w as ({ROLL.format(29)}))"""


def _spread_z(spark, sf):
    x = F.col("spread")
    z = (x - windows.rolling(F.avg, x, _w(), 30, 10)) / F.greatest(windows.rolling(F.stddev_samp, x, _w(), 30, 10), F.lit(1e-8))
    return _spread(spark, sf).select("symbol", "ts", z.alias("z"))


@query(f"{SPREAD_Z} select symbol, ts, round(z, 5) z, coalesce(round(z, 5) > 3, false) anomaly from z")
def spread_zscore_anomaly(spark, sf):
    return _spread_z(spark, sf).select("symbol", "ts", R(F.col("z"), "z", 5), F.coalesce(F.round("z", 5) > 3, F.lit(False)).alias("anomaly"))


@query(f"""{SPREAD_Z}, last3 as (select symbol, z, row_number() over (partition by symbol order by ts desc) r from z)
  select symbol, case when max(case when r = 1 then round(z, 5) end) > 3 or round(avg(z), 5) > 2 then 'BLOCKED' else 'OPEN' end status from last3 where r <= 3 group by symbol""")
def breaker_status(spark, sf):
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = _spread_z(spark, sf).withColumn("back", back).where("back <= 3").groupBy("symbol").agg(F.max(F.when(F.col("back") == 1, F.col("z"))).alias("z"), F.avg("z").alias("mean"))
    return last.select("symbol", F.when((F.round("z", 5) > 3) | (F.round("mean", 5) > 2), "BLOCKED").otherwise("OPEN").alias("status"))


WEIGHTS = """with recursive wts(k, w) as (select 0, 1.0::double union all select k + 1, -w * (0.9::double - (k + 1) + 1) / (k + 1) from wts where abs(w * (0.9::double - k) / (k + 1)) >= 1e-5)"""


def _fracdiff(spark, sf, reverse):
    w = windows.fracdiff_weights(0.9)
    n = len(w)
    literal = F.array(*[F.lit(x) for x in (w if reverse else w[::-1])])
    frame = F.collect_list(F.ln("close")).over(_w().rowsBetween(-(n - 1), 0))
    dot = F.aggregate(F.zip_with("f", literal, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return bars_daily(spark, sf).withColumn("f", frame).select("symbol", "ts", R(F.when(F.size("f") == n, dot), "fracdiff", 5))


FRAC = WEIGHTS + f""", {BARS}, n as (select symbol, ts, ln("close") x, row_number() over (partition by symbol order by ts) n from bars)
  select a.symbol, a.ts, round(case when a.n >= 125 then sum(b.x * w) end, 5) + 0.0::double fracdiff from n a join n b on a.symbol = b.symbol and b.n between a.n - 124 and a.n join wts on k = {{}} group by a.symbol, a.ts, a.n"""


@query(FRAC.format("a.n - b.n"))
def fracdiff_dot(spark, sf):
    return _fracdiff(spark, sf, False)


@query(FRAC.format("124 - (a.n - b.n)"))
def fracdiff_reversed(spark, sf):
    return _fracdiff(spark, sf, True)


LABELLED = RET + EWM.format(src="ret", x="r", d="(1 - 2.0::double / 21)") + f""",
  sig as (select symbol, ts, high, low, "close", quote_volume, case when c >= 5 then sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q), 0)) end sigma, (high - low) / ((high + low) / 2) rv,
          row_number() over (partition by symbol order by ts) k from cum),
  ev as (select symbol, ts, k, "close" p0, round(sigma, 9) s, greatest(2, least(5, cast(round_even(5.0::double * greatest(0.5::double, least(1.25::double, 0.03::double / round(sigma, 9))), 0) as int))) hold from sig where sigma > 0),
  lv as (select *, p0 * (1 - 1.5::double * s) sl, p0 * (1 + 1.5::double * s) tp from ev),
  tch as (select lv.symbol, lv.k, min(b.k) hk from lv join sig b on b.symbol = lv.symbol and b.k between lv.k + 1 and lv.k + hold and (b.low <= sl or b.high >= tp) group by lv.symbol, lv.k),
  lst as (select lv.symbol, lv.k, max(b.k) lk from lv join sig b on b.symbol = lv.symbol and b.k between lv.k and lv.k + hold group by lv.symbol, lv.k),
  lab as (select lv.symbol, lv.ts event_date, coalesce(h.ts, l.ts) t_touch, case when h.k is null then 0 when h.low <= sl then -1 else 1 end "label", hold, s, p0,
          case when h.k is null then l."close" when h.low <= sl then sl * (1 - least(0.1::double * greatest(h.rv, 0) * sqrt(10000.0::double / greatest(h.quote_volume, 1e-10)), 0.5)) else tp end x
          from lv left join tch using (symbol, k) join lst using (symbol, k) left join sig h on h.symbol = lv.symbol and h.k = tch.hk join sig l on l.symbol = lv.symbol and l.k = lst.lk)"""


def barriers(spark, sf):
    df = windows.ewm(_returns(spark, sf), "symbol", "ts", "r", 20, 5, "sigma", std=True)
    df = df.withColumn("range_vol", (F.col("high") - F.col("low")) / ((F.col("high") + F.col("low")) / 2))
    return labels.triple_barrier(df, "sigma")


@query(f"""{LABELLED} select symbol, event_date, t_touch, "label", hold holding_limit, round(x, 6) exit_price, round(x / p0 - 1, 5) + 0.0::double pnl from lab""")
def triple_barrier(spark, sf):
    return barriers(spark, sf).select("symbol", "event_date", "t_touch", "label", "holding_limit", R(F.col("exit_price"), "exit_price"), R(F.col("pnl_real"), "pnl", 5))


@query(f"""{LABELLED} select symbol, count(*) n, round(avg(("label" = 1)::int), 6) share_tp, round(avg(("label" = -1)::int), 6) share_sl, round(avg(("label" = 0)::int), 6) share_time, round(avg(x / p0 - 1), 5) mean_pnl from lab group by symbol""")
def barrier_distribution(spark, sf):
    share = lambda k, name: R(F.avg((F.col("label") == k).cast("int")), name)
    return barriers(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), share(1, "share_tp"), share(-1, "share_sl"), share(0, "share_time"), R(F.avg(F.col("exit_price") / F.col("p0") - 1), "mean_pnl", 5))


CONC = f"""{LABELLED}, u as (select a.symbol, a.event_date, any_value(a."label") "label", count(*) c from lab a join lab b on a.symbol = b.symbol and b.event_date <= a.t_touch and b.t_touch >= a.event_date group by a.symbol, a.event_date)"""


@query(f"{CONC} select symbol, event_date, c concurrency, round(1.0::double / c, 6) uniqueness from u")
def label_uniqueness(spark, sf):
    return labels.uniqueness(barriers(spark, sf)).select("symbol", "event_date", "concurrency", R(F.col("uniqueness"), "uniqueness"))


@query(f"{CONC} select symbol, round(sum(1.0::double / c), 4) n_eff, case when sum(1.0::double / c) < 60 then 'logistic' when sum(1.0::double / c) < 120 then 'strict' else 'standard' end model from u group by symbol")
def effective_n(spark, sf):
    n = F.sum("uniqueness")
    return labels.uniqueness(barriers(spark, sf)).groupBy("symbol").agg(R(n, "n_eff", 4), F.when(n < 60, "logistic").when(n < 120, "strict").otherwise("standard").alias("model"))


@query(f"""{CONC}, m as (select symbol, event_date, (1.0::double / c) * exp(-date_diff('day', event_date, max(event_date) over (partition by symbol)) / 180.0::double) * case when "label" = -1 then 2.0::double else 1.0 end w from u)
  select symbol, event_date, round(w / avg(w) over (partition by symbol), 6) weight from m""")
def sample_weights(spark, sf):
    from pyspark.sql import Window

    df = labels.uniqueness(barriers(spark, sf)).withColumn("ago", F.datediff(F.max("event_date").over(Window.partitionBy("symbol")), "event_date"))
    return df.select("symbol", "event_date", R(labels.sample_weight(F.col("ago"), F.col("uniqueness"), F.col("label"), ["symbol"]), "weight"))
