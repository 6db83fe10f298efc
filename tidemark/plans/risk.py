"""Sizes of candidates beside open positions, stress of portfolios, and honest Sharpe ratios."""

from pyspark.sql import functions as F

from tidemark.operators import panel, portfolio
from tidemark.plans.register import registry
from tidemark.sources.views import TRADES, trades

query, QUERIES, ORACLES = registry()
#: The rational form of the normal distribution that the library uses, in SQL.
ERF = "(1 - ({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))) * exp(-({z}) * ({z})))"


def _conviction(p: str) -> str:
    """Twice 0.08 times the normal distribution's excess over a half at (p - 0.5) / 0.1, for p of 0.5 or more."""
    z = f"((({p}) - 0.5) / 0.1 / sqrt(2))"
    return "(0.08 * " + ERF.format(t=f"(1 / (1 + 0.3275911 * {z}))", z=z) + ")"


LOSS = portfolio.TAIL_LOSS
HELD = f"with {TRADES}" + """, held as (select "cluster" portfolio, symbol, avg("position") / 4000.0 / 4 fraction, stddev_samp(pnl) sigma, sum("position") / 20 "value" from trades group by 1, 2)"""


def _held(spark, sf):
    own = trades(spark, sf).groupBy(F.col("cluster").alias("portfolio"), "symbol")
    return own.agg((F.avg("position") / 4000.0 / 4).alias("fraction"), F.stddev_samp("pnl").alias("sigma"), (F.sum("position") / 20).alias("value"))


@query(HELD + f""", c as (select row_id, t."cluster" portfolio, t.symbol, score p, regime * 0.1 + 0.01 sigma, 200000.0::double capital, 200000.0::double * (1 + (row_id % 10) / 60.0::double) peak from trades t),
  w as (select portfolio, sum(fraction * sigma) whole, sum(fraction) whole_f from held group by 1),
  a as (select c.*, p * 1.5 * sigma - (1 - p) * 1.5 * sigma mu, greatest(0, 1 - greatest(1 - capital / peak, 0) / 0.18) scalar from c),
  k as (select a.*, case when p > 0.51 and mu > 0 then least({_conviction('p')}, least(0.25 * mu / greatest(sigma * sigma, 1e-8), 0.08)) else 0 end kelly, p > 0.51 and mu > 0 and scalar > 0 ok from a),
  q as (select k.*, case when ok then kelly * capital * scalar else 0 end wanted, whole - coalesce(h.fraction * h.sigma, 0) rest, whole_f - coalesce(h.fraction, 0) rest_f from k join w using (portfolio) left join held h on h.portfolio = k.portfolio and h.symbol = k.symbol),
  s as (select *, {LOSS} * (rest + wanted / capital * sigma) first from q), t as (select *, case when first > 0.15 then wanted * 0.15 / first else wanted end cut from s)
  select row_id, round(kelly, 6) kelly, round(wanted, 4) wanted, round(case when ok then {LOSS} * (rest + cut / capital * sigma) else 0 end, 6) cvar, round(case when ok then greatest(least(cut, 10000), 50) else 0 end, 4) size from t""")
def portfolio_sizes(spark, sf):
    """What each trade may bind beside the open positions of its portfolio."""
    c = F.col
    rows = trades(spark, sf).select("row_id", c("cluster").alias("portfolio"), "symbol", c("score").alias("p"), (c("regime") * 0.1 + 0.01).alias("sigma"), F.lit(200000.0).alias("capital"), (200000.0 * (1 + (c("row_id") % 10) / 60.0)).alias("peak"))
    sized = portfolio.position_sizes(rows, _held(spark, sf))
    return sized.select("row_id", F.round("kelly", 6).alias("kelly"), F.round("wanted", 4).alias("wanted"), F.round("cvar", 6).alias("cvar"), F.round("size", 4).alias("size"))


@query(HELD + f""", o as (select portfolio, sum("value" / 200000) exposure, sum("value" / 200000 * sigma) sigma, count(*) n from held group by 1), b as (select "cluster" portfolio, symbol, pnl, row_number() over (partition by "cluster", symbol order by "date" desc, row_id desc) - 1 k from trades),
  j as (select b.portfolio, k, sum(pnl * "value" / 200000) pnl from b join held using (portfolio, symbol) group by 1, 2 having count(*) = (select n from o where o.portfolio = b.portfolio)),
  r as (select *, row_number() over (partition by portfolio order by pnl, k) - 1 below, count(*) over (partition by portfolio) common from j), t as (select portfolio, -avg(pnl) past from r where common >= 30 and below < greatest(1, floor(common * 0.05)) group by 1)
  select portfolio, n n_positions, round(exposure * 100, 4) exposure_pct, round(coalesce(past, {LOSS} * sigma), 6) cvar_historical, round({LOSS} * sigma, 6) cvar_stress, round(0.15 - {LOSS} * sigma, 6) margin, {LOSS} * sigma <= 0.15 cvar_ok,
    round({LOSS} * sigma / greatest(coalesce(past, {LOSS} * sigma), 1e-10), 4) hidden_risk, round(sigma, 6) sigma_stress from o left join t using (portfolio)""")
def portfolio_stress(spark, sf):
    """What each portfolio would lose if all fell together, and what it lost."""
    history = trades(spark, sf).select(F.col("cluster").alias("portfolio"), "symbol", "pnl", "date", "row_id")
    rows = portfolio.stress_report(_held(spark, sf).withColumn("capital", F.lit(200000.0)), history, ["date", "row_id"])
    digits = {"exposure_pct": 4, "cvar_historical": 6, "cvar_stress": 6, "margin": 6, "hidden_risk": 4, "sigma_stress": 6}
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(f"with {TRADES}" + f""", e as (select row_id, score p, case when score >= 0.5 then score * 0.06 - (1 - score) * (0.02 + slippage / 10) else 0 end mu, regime * 0.1 sigma from trades),
  k as (select *, case when mu > 0 and p > 0.51 then least({_conviction('p')}, least(0.25 * mu / greatest(greatest(sigma, 1e-6) * greatest(sigma, 1e-6), 1e-8), 0.08)) else 0 end kelly from e)
  select row_id, round(mu, 8) mu, round(kelly, 6) kelly, round(least(kelly * 200000, 16000), 3) "position" from k""")
def meta_sizes(spark, sf):
    sized = portfolio.meta_sizes(F.col("score"), F.col("regime") * 0.1, F.lit(0.06), 0.02 + F.col("slippage") / 10)
    return trades(spark, sf).select("row_id", sized.alias("s")).select("row_id", F.round("s.mu", 8).alias("mu"), F.round("s.kelly", 6).alias("kelly"), F.round("s.position", 3).alias("position"))


@query()
def honest_sharpe(spark, sf):
    """How each symbol's Sharpe ratio stands against the best of 500 and 5,000 trials without skill."""
    return portfolio.honest_sharpe(panel.portfolio_returns(trades(spark, sf), 0.6), ["symbol"])
