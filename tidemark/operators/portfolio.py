"""Sizes that depend on all other positions, the stress report of a portfolio, and how good a Sharpe ratio must be."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sizing
from tidemark.operators.prefix import prefix_sum

#: Tail, limit of its mean loss, bounds of a position, volatility of an unknown symbol, least common history.
TAIL, CVAR_LIMIT, LEAST_POSITION, MOST_POSITION, SIGMA, HISTORY = 0.05, 0.15, 50.0, 10_000.0, 0.02, 30
#: Mean loss in the tail of a normal distribution, in standard deviations.
TAIL_LOSS = NormalDist().pdf(NormalDist().inv_cdf(TAIL)) / TAIL
CUTOFF = 0.51
#: Trials that a Sharpe ratio is held against, and the chance that it must reach.
SURFACE, HONEST, SURE = 500, 5000, 0.95


def edge(p: Column, gain: Column, loss: Column) -> Column:
    """What is expected of a trade that gains with probability p."""
    return p * gain - (1 - p) * loss


def meta_sizes(p: Column, sigma: Column, gain: Column, loss: Column, capital: float = 200_000.0) -> Column:
    """(mu, kelly, position) of a prediction: nothing below even chances, no position without an edge, 8 % of the capital at most.

    A null probability is 0, a null volatility 0.01, a null gain or loss 0.02.
    """
    p = F.greatest(F.least(F.coalesce(p, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    sigma, gain, loss = (F.greatest(F.coalesce(x, F.lit(d)), F.lit(1e-6)) for x, d in ((sigma, 0.01), (gain, 0.02), (loss, 0.02)))
    mu = F.when(p >= 0.5, edge(p, gain, loss)).otherwise(0.0)
    kelly = F.when(mu > 0, sizing.kelly_fraction(mu, sigma, p)).otherwise(0.0)
    return F.struct(mu.alias("mu"), kelly.alias("kelly"), F.least(kelly * capital, F.lit(capital * 0.08)).alias("position"))


def position_sizes(candidates: DataFrame, held: DataFrame, k_tp: float = 1.5, k_sl: float = 1.5, limit: float = CVAR_LIMIT) -> DataFrame:
    """Adds mu, kelly, scalar, wanted, cvar, cvar_ok and size to ``candidates`` (portfolio, symbol, p, sigma, capital, peak).

    ``held`` (portfolio, symbol, fraction, sigma) are the positions that each candidate would join, in place of its own
    symbol's. The stressed loss adds all of them up as if they fell together; where it exceeds the limit the candidate
    shrinks in proportion, and the loss is worked out again. Sizes lie between 50 and 10,000; there is none up to a
    probability of 0.51, without an edge or with the drawdown used up. Symbols without sigma have 0.02.
    """
    loss = F.col("fraction") * F.coalesce("sigma", F.lit(SIGMA))
    own = held.groupBy("portfolio", "symbol").agg(F.sum(loss).alias("_own"), F.sum("fraction").alias("_own_f"))
    whole = held.groupBy("portfolio").agg(F.sum(loss).alias("_whole"), F.sum("fraction").alias("_whole_f"))
    rows = candidates.join(own, ["portfolio", "symbol"], "left").join(F.broadcast(whole), "portfolio", "left").na.fill(0.0, ["_own", "_own_f", "_whole", "_whole_f"])  # a row per portfolio
    c = F.col
    mu = edge(c("p"), k_tp * c("sigma"), k_sl * c("sigma"))
    scalar = sizing.drawdown_scalar(c("capital"), c("peak"))
    open_ = (c("p") > CUTOFF) & (c("mu") > 0) & (c("scalar") > 0)
    rows = rows.withColumns({"mu": mu, "scalar": scalar})
    rows = rows.withColumn("kelly", F.when((c("p") > CUTOFF) & (c("mu") > 0), sizing.kelly_fraction(c("mu"), c("sigma"), c("p"))).otherwise(0.0))
    rows = rows.withColumn("wanted", F.when(open_, c("kelly") * c("capital") * c("scalar")).otherwise(0.0))

    def stressed(size: Column) -> Column:
        fraction = size / c("capital")
        together = c("_whole") - c("_own") + fraction * c("sigma")
        return F.when(c("_whole_f") - c("_own_f") + fraction > 0, TAIL_LOSS * together).otherwise(0.0)

    rows = rows.withColumn("_first", stressed(c("wanted")))
    rows = rows.withColumn("_cut", F.when(c("_first") > limit, c("wanted") * limit / F.greatest("_first", F.lit(1e-10))).otherwise(c("wanted")))
    rows = rows.withColumn("cvar", F.when(open_, stressed(c("_cut"))).otherwise(0.0))
    size = F.when(open_, F.greatest(F.least("_cut", F.lit(MOST_POSITION)), F.lit(LEAST_POSITION))).otherwise(0.0)
    return rows.withColumns({"cvar_ok": c("cvar") <= limit, "size": size}).select(*candidates.columns, "mu", "kelly", "scalar", "wanted", "cvar", "cvar_ok", "size")


def stress_report(positions: DataFrame, history: DataFrame, order: list[str]) -> DataFrame:
    """A row per portfolio of ``positions`` (portfolio, symbol, value, sigma, capital): stressed against historical loss.

    ``history`` (portfolio, symbol, pnl and the columns of ``order``) is aligned from the last trade back over what all
    symbols have; with fewer than 30 common trades, or a symbol without any, the historical loss is the stressed one. The
    mean loss is over the worst twentieth. A portfolio of nothing has no loss.
    """
    share = F.col("value") / F.col("capital")
    one = positions.groupBy("portfolio").agg(F.sum(share).alias("exposure"), F.sum(share * F.coalesce("sigma", F.lit(SIGMA))).alias("sigma"), F.count("*").alias("n_positions"))
    one = one.withColumn("stress", F.when(F.col("exposure") > 0, TAIL_LOSS * F.col("sigma")).otherwise(0.0))
    finite = history.where(F.col("pnl").isNotNull() & ~F.isnan("pnl") & (F.abs("pnl") < float("inf"))).withColumn("_one", F.lit(1).cast("long"))
    back = prefix_sum(finite, ["portfolio", "symbol"], [F.col(c).desc() for c in order], "_one", "k")
    weighed = back.join(positions.select("portfolio", "symbol", share.alias("w")), ["portfolio", "symbol"])
    # a common outcome has all of the portfolio's symbols, which only the first trades from the end have
    joint = weighed.groupBy("portfolio", "k").agg(F.sum(F.col("pnl") * F.col("w")).alias("pnl"), F.count("*").alias("n")).join(one.select("portfolio", "n_positions"), "portfolio").where(F.col("n") == F.col("n_positions"))
    n = joint.groupBy("portfolio").agg(F.count("*").alias("common"))
    ranked = prefix_sum(joint.select("portfolio", "pnl", "k", F.lit(1).cast("long").alias("_one")), ["portfolio"], [F.col("pnl"), F.col("k")], "_one", "_below")
    worst = ranked.join(n, "portfolio").where((F.col("common") >= HISTORY) & (F.col("_below") < F.greatest(F.lit(1), F.floor(F.col("common") * TAIL)))).groupBy("portfolio").agg((-F.avg("pnl")).alias("historical"), F.first("common").alias("common"))
    rows = one.join(worst, "portfolio", "left")
    past = F.when(F.col("exposure") > 0, F.coalesce("historical", "stress")).otherwise(0.0)
    return rows.select(
        "portfolio", "n_positions", (F.col("exposure") * 100).alias("exposure_pct"), past.alias("cvar_historical"), F.col("stress").alias("cvar_stress"), (CVAR_LIMIT - F.col("stress")).alias("margin"),
        (F.col("stress") <= CVAR_LIMIT).alias("cvar_ok"), (F.col("stress") / F.greatest(past, F.lit(1e-10))).alias("hidden_risk"), F.col("sigma").alias("sigma_stress"),
    )


def _chance(sharpe: Column, n: Column, skew: Column, kurtosis: Column, trials: int) -> Column:
    """The chance that a Sharpe ratio is above what the best of so many trials reaches without any skill."""
    norm, gamma = NormalDist(), 0.5772156649015329
    best = (1 - gamma) * norm.inv_cdf(1 - 1 / trials) + gamma * norm.inv_cdf(1 - 1 / (trials * math.e))
    variance = (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1)
    return sizing.normal_cdf((sharpe - best) / F.sqrt(F.greatest(variance, F.lit(1e-12))))


def honest_sharpe(rows: DataFrame, keys: list[str], steps: int = 1000) -> DataFrame:
    """(keys, n, sharpe, surface, honest, passed, needed) of the returns ``ret`` of each group.

    Chances are against 500 and 5,000 trials; ``needed`` is the least ratio of an even grid from 0.5 to 5 that would
    pass at 5,000, null if the group passes or none does. Up to ten returns have the moments of a skewed heavy tail, and
    fewer than five a ratio of 0; a group counts as 100 returns at least.
    """
    one = rows.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("_mean"), F.stddev_pop("ret").alias("_std"), F.skewness("ret").alias("_skew"), F.kurtosis("ret").alias("_kurt"))
    c = F.col
    sharpe = F.when(c("n") >= 5, c("_mean") / (c("_std") + 1e-10) * F.sqrt(F.lit(sizing.PERIODS))).otherwise(0.0)
    enough = c("n") > 10
    one = one.select(*keys, "n", sharpe.alias("sharpe"), F.when(enough, c("_skew")).otherwise(-0.3).alias("_skew"), F.when(enough, c("_kurt") + 3).otherwise(5.0).alias("_kurt"), F.greatest("n", F.lit(100)).alias("_t"))
    chance = lambda s, trials: _chance(s, c("_t"), c("_skew"), c("_kurt"), trials)
    one = one.withColumns({"surface": chance(c("sharpe"), SURFACE), "honest": chance(c("sharpe"), HONEST)})
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: 0.5 + i * (4.5 / (steps - 1)))
    needed = F.get(F.filter(grid, lambda s: chance(s, HONEST) > SURE), F.lit(0))
    return one.select(*keys, "n", "sharpe", "surface", "honest", (c("honest") > SURE).alias("passed"), F.when(c("honest") <= SURE, F.round(needed, 2)).alias("needed"))


def weighted(df: DataFrame, day: str, out: str, life: float = 180.0) -> DataFrame:
    """Adds ``out``: half for each ``life`` days of ``day`` before the last."""
    last = df.agg(F.max(day).alias("_last"))
    return df.join(F.broadcast(last)).withColumn(out, F.pow(F.lit(0.5), F.datediff("_last", day) / life)).drop("_last")  # one row


def cluster_calibrated(df: DataFrame, key: str, cluster: str, p: str, y: str, day: str, fit, least: int = 150, life: float = 180.0, count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds ``calibrated``: ``p`` through the increasing fit of its cluster, or of all rows where the cluster has fewer than ``least``.

    Rows weigh half for each ``life`` days before the last. ``fit`` turns sorted (p, mean, weight) into fitted means;
    what it sees is a row per distinct rounded p, counted before. A p of 0 stays 0. Also returns a row per cluster: n,
    mode, and the mean gap between ten classes of p and what came, before and after. A row stands for the number in
    column ``count``, if named; ``day`` is then the sum of their weights, as ``weighted`` gives them.
    """
    rows = df.withColumn("_w", F.col(day)) if count else weighted(df, day, "_w", life)
    rows = rows.withColumn("_p", F.round(F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001)), 4))
    times = F.col(count) if count else F.lit(1).cast("long")
    sizes = rows.groupBy(cluster).agg(F.sum(times).alias("n")).withColumn("mode", F.when(F.col("n") < max(60, least), "global").otherwise("own"))
    points = [F.sum("_w").alias("_n"), (F.sum(F.col("_w") * F.col(y)) / F.sum("_w")).alias("_m")]
    own = rows.join(F.broadcast(sizes.where("mode = 'own'").select(cluster)), cluster).groupBy(F.col(cluster).alias("_c"), "_p").agg(*points)  # clusters are few
    pool = rows.groupBy("_p").agg(*points).select(F.lit(None).cast(dict(df.dtypes)[cluster]).alias("_c"), "_p", "_n", "_m")

    def curve(frame):
        frame = frame.sort_values("_p")
        return frame.assign(calibrated=fit(frame["_m"].to_numpy(), frame["_n"].to_numpy()))[["_c", "_p", "calibrated"]]

    curves = own.unionByName(pool).groupBy("_c").applyInPandas(curve, f"_c {dict(df.dtypes)[cluster]}, _p double, calibrated double")
    tagged = rows.join(F.broadcast(sizes), cluster).withColumn("_use", F.when(F.col("mode") == "own", F.col(cluster)))
    met = tagged.join(curves.withColumnRenamed("_p", "_q"), F.col("_use").eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_q")))
    out = met.withColumn("calibrated", F.when(F.col(p) <= 0, 0.0).otherwise(F.col("calibrated")))

    def gap(x: str) -> DataFrame:
        bins = out.groupBy(cluster, F.least(F.floor(F.col(x) * 10), F.lit(9)).alias("_b")).agg(F.sum(times).alias("n"), (F.sum(F.col(x) * times) / F.sum(times)).alias("a"), (F.sum(F.col(y) * times) / F.sum(times)).alias("h"))
        return bins.groupBy(cluster).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("h"))) / F.sum("n")).alias(f"gap_{x}"))

    report = sizes.join(gap(p).withColumnRenamed(f"gap_{p}", "gap_before"), cluster).join(gap("calibrated").withColumnRenamed("gap_calibrated", "gap_after"), cluster)
    return out.select(*df.columns, "calibrated"), report
