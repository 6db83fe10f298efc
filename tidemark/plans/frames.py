"""The features of all symbols in one frame, its filled form and its coverage."""

from pyspark.sql import functions as F

from tidemark.operators import frame, windows
from tidemark.plans.market import EWM, RET, ROLL
from tidemark.plans.register import registry
from tidemark.sources.folders import checkpointed
from tidemark.sources.views import bars_daily

query, QUERIES, ORACLES = registry()
FEATURES = [*frame.OWN, frame.FLAG, "basis_3m", "stablecoin_chg30", "funding_ma7", "unlock_rank"]
NEUTRAL = {frame.FLAG: 0.5, "unlock_rank": 0.5}


def _frame(spark, sf):
    """Bars of six symbols; a basis between two of them, a change that is known on Mondays, and a symbol's own values once a week."""
    bars = checkpointed(bars_daily(spark, sf))
    of = lambda s: bars.where(F.col("symbol") == s)
    basis = of("AF").select("ts", F.col("close").alias("s")).join(of("RO").select("ts", F.col("close").alias("f")), "ts").select("ts", F.col("f") / F.col("s") - 1)
    stable = of("AF").select("ts", windows.change(F.col("quote_volume"), windows.series(["symbol"], "ts"), 30).alias("v")).where(F.dayofweek("ts") == 2)
    weekly = bars.where(F.datediff("ts", F.lit("1970-01-01").cast("date")) % 7 == 0)
    own = weekly.select("symbol", "ts", (F.col("close") / F.col("open") - 1).alias("funding_ma7"), F.when(F.col("n_trades") % 5 > 0, F.col("n_trades") / 4).alias("unlock_rank"))
    return frame.feature_frame(bars, of("AF").select("ts", "close"), {"basis_3m": basis, "stablecoin_chg30": stable}, own, ("unlock_rank",))


SQL = RET + ", rng as (select *, case when high + low <> 0 then (high - low) / ((high + low) / 2) end x from ret)" + EWM.format(src="rng", x="x", d="(1 - 2.0::double / 21)") + f""",
  v as (select *, case when c >= 5 then s1 / s0 end pv from cum),
  f as (select symbol, ts, "open", "close", n_trades, quote_volume, r ret_1d, ln("close" / lag("close", 5) over o) ret_5d, ln("close" / lag("close", 20) over o) ret_20d, case when count(r) over l >= 10 then stddev_samp(r) over l end vl, case when count(r) over s >= 3 then stddev_samp(r) over s end vs, pv,
    case when count(pv) over z >= 30 then avg(pv) over z end zm, case when count(pv) over z >= 30 then stddev_samp(pv) over z end zs, coalesce(case when count("close") over t >= 100 then ("close" > avg("close") over t)::int end, 0)::double tf,
    case when lag(quote_volume, 30) over o > 0 then quote_volume / lag(quote_volume, 30) over o - 1 end chg
    from v window o as (partition by symbol order by ts), s as ({ROLL.format(4)}), l as ({ROLL.format(29)}), z as ({ROLL.format(89)}), t as ({ROLL.format(199)})),
  tr as (select ts, tf from f where symbol = 'AF'), ba as (select a.ts, b."close" / a."close" - 1 basis from f a join f b on a.ts = b.ts and a.symbol = 'AF' and b.symbol = 'RO'), st as (select ts, chg from f where symbol = 'AF' and dayofweek(ts) = 1),
  ow as (select symbol, ts, "close" / "open" - 1 fu, case when n_trades % 5 > 0 then n_trades / 4.0::double end un from f where date_diff('day', date '1970-01-01', ts) % 7 = 0),
  j as (select f.*, coalesce(tr.tf, 0.5) flag, basis, st.chg stable, fu, un from f asof left join tr on f.ts >= tr.ts asof left join ba on f.ts >= ba.ts asof left join st on f.ts >= st.ts asof left join ow on f.symbol = ow.symbol and f.ts >= ow.ts),
  fr as (select symbol, ts, ret_1d, ret_5d, ret_20d, vl * sqrt(365) realized_vol_30d, case when vs is not null and vl is not null then least(greatest(vs / greatest(vl, 1e-8), 0), 5) end vol_ratio, case when zm is not null then least(greatest((pv - zm) / greatest(zs, 1e-8), -4), 4) end dvol_zscore,
    flag reference_ma200_flag, basis basis_3m, stable stablecoin_chg30, fu funding_ma7, case when un is not null then least(greatest(un, 0), 1) end unlock_rank from j)"""
_ROUNDED = ", ".join(f"round({c}, 5) + 0.0::double {c}" for c in FEATURES)


@query(f"{SQL} select symbol, ts, {_ROUNDED} from fr")
def feature_frame(spark, sf):
    return _frame(spark, sf).withColumns({c: F.round(c, 5) for c in FEATURES})


_FILLED = ", ".join(f"round(coalesce(last_value({c} ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and current row), {NEUTRAL.get(c, 0.0)}), 5) + 0.0::double {c}" for c in FEATURES)
_GONE = " + ".join(f"({c} is null)::int" for c in FEATURES)


@query(f"{SQL} select symbol, ts, {_GONE} filled, {_FILLED} from fr")
def model_frame(spark, sf):
    return frame.model_frame(_frame(spark, sf), FEATURES, NEUTRAL).withColumns({c: F.round(c, 5) for c in FEATURES})


@query(SQL + f", u as (unpivot (select symbol, ts, {', '.join(f'({c} is not null)::int {c}' for c in FEATURES)} from fr) on {', '.join(FEATURES)} into name feature value ok) select symbol, feature, count(*) n_rows, sum(ok)::bigint n_valid, round(avg(ok), 6) share, min(ts) filter (ok = 1) first_day, max(ts) filter (ok = 1) last_day from u group by 1, 2")
def feature_coverage(spark, sf):
    return frame.coverage(_frame(spark, sf), FEATURES).withColumn("share", F.round("share", 6))
