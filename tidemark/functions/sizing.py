"""Position sizing and risk columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = 50.4


def drawdown_scalar(current: Column, peak: Column, most: float = 0.18) -> Column:
    dd = F.least(F.greatest(1 - F.try_divide(current, peak), F.lit(0.0)), F.lit(1.0))
    return F.when(peak <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dd / most))


def normal_cdf(x: Column) -> Column:
    """Phi by a rational form of the error function; its error is under 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def kelly_fraction(mu: Column, sigma: Column, p: Column, kappa: float = 0.25, ceiling: float = 0.08) -> Column:
    """The lesser of fractional Kelly and a bound that grows with the probability; 0 unless p > 0.51 and mu > 0."""
    conviction = (normal_cdf((p - 0.5) / 0.1) - 0.5) * 2 * ceiling
    kelly = F.least(kappa * mu / F.greatest(sigma * sigma, F.lit(1e-8)), F.lit(ceiling))
    return F.when((p <= 0.51) | (mu <= 0), 0.0).otherwise(F.least(conviction, kelly))


def rescale_slippage(slippage: Column, position: Column, reference: float) -> Column:
    return F.when(position > 0, F.least(slippage * F.sqrt(position / reference), F.lit(0.5))).otherwise(slippage)


def execution_pnl(pnl: Column, label: Column, slippage: Column, position: Column, stop: Column, p0: Column, reference: float) -> Column:
    """Stopped trades priced again at the slippage of their own size."""
    fires = (label == -1) & (slippage > 0) & (position > 0)
    return F.when(fires, stop * (1 - rescale_slippage(slippage, position, reference)) / p0 - 1).otherwise(pnl)


def friction_pnl(pnl: Column, label: Column, slippage: Column, position: Column, stop: Column, p0: Column, times: float, bps: float) -> Column:
    """Stopped trades at a multiple of their slippage; every open trade pays some basis points."""
    worse = F.when((label == -1) & (slippage > 0), stop * (1 - F.least(slippage * times, F.lit(0.5))) / p0 - 1).otherwise(pnl)
    return worse - F.when(position > 0, bps / 1e4).otherwise(0.0)


def pre_trade(drawdown: Column, cvar: Column, systemic: Column, bull: Column, breaker: Column, drift: Column, position: Column, scalar: Column) -> Column:
    """(approved, level, reason, size) by the first rule that objects, else by the first warning.

    Halts (3): drawdown, cvar, systemic drift. Blocks (2): a bear regime, a blocked spread breaker, severe drift. Above a
    cvar of 0.15 the size shrinks in proportion. Null states object to nothing.
    """
    halt = F.when(drawdown >= 0.18, "drawdown").when(cvar > 0.20, "cvar").when(systemic, "systemic_drift")
    block = F.when(~bull, "bear").when(breaker == "BLOCKED", "spread_breaker").when(drift == "SEVERE", "severe_drift")
    warn = F.when(drift == "MODERATE", "moderate_drift").when(drawdown > 0.09, "drawdown_warning")
    good = halt.isNull() & block.isNull()
    size = position * scalar * F.when(cvar > 0.15, F.lit(0.15) / cvar).otherwise(1.0)
    level = F.when(halt.isNotNull(), 3).when(block.isNotNull(), 2).when(warn.isNotNull(), 1).otherwise(0)
    return F.struct(good.alias("approved"), level.alias("level"), F.coalesce(halt, block, warn, F.lit("ok")).alias("reason"), F.when(good, size).otherwise(0.0).alias("size"))


def alarm_level(scalar: Column, cvar: Column, systemic: Column, bull: Column, breaker: Column, drift: Column, auc: Column) -> Column:
    """3 halts all, 2 blocks the symbol, 1 warns, 0 is clear; null states raise nothing."""
    return (
        F.when((scalar == 0) | (cvar > 0.20) | systemic, 3)
        .when(~bull | (breaker == "BLOCKED") | drift.isin("MODERATE", "SEVERE"), 2)
        .when((scalar > 0) & (scalar < 0.75) | cvar.between(0.15, 0.18) | (auc > 0.52), 1)
        .otherwise(0)
    )


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int) -> float:
    """The probability that a Sharpe ratio beats the best of so many trials by chance (kurtosis of a normal: 3)."""
    norm, gamma = NormalDist(), 0.5772156649015329
    best = (1 - gamma) * norm.inv_cdf(1 - 1 / trials) + gamma * norm.inv_cdf(1 - 1 / (trials * math.e))
    spread = math.sqrt(max(1e-12, (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / max(n - 1, 1)))
    return norm.cdf((sharpe - best * spread) / spread)
