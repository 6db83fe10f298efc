"""Small models per series or fold, in grouped maps, and pyspark.ml models over folds.

A group is one series (rows of a symbol), which is bounded by the length of its history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The best non-decreasing fit to weighted means in order."""
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def isotonic_by(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Adds ``calibrated``, the isotonic fit per group; the fit sees a row per distinct x, aggregated before the shuffle."""
    points = df.groupBy(key, x).agg(F.avg(y).alias("_m"), F.count("*").alias("_n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(x)
        return pd.DataFrame({key: frame[key], x: frame[x], "calibrated": isotonic(frame["_m"].to_numpy(), frame["_n"].to_numpy())})

    kinds = dict(df.dtypes)
    return df.join(points.groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, {x} {kinds[x]}, calibrated double"), [key, x])


def _weights(d: float, n: int) -> np.ndarray:
    k = np.arange(1, n)
    return np.concatenate([[1.0], np.cumprod(-(d - k + 1) / k)])


def adf_statistic(x: np.ndarray) -> float:
    """The t value of the lagged level in a regression of steps on level, one lagged step and a constant."""
    dx = np.diff(x)
    y, z = dx[1:], np.column_stack([x[1:-1], dx[:-1], np.ones(len(dx) - 1)])
    beta, *_ = np.linalg.lstsq(z, y, rcond=None)
    rest = y - z @ beta
    var = rest @ rest / max(1, len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)
    return float(beta[0] / np.sqrt(max(var[0, 0], 1e-300)))


def optimal_d(df: DataFrame, key: str, order: str, price: str, cut: float = -2.86, tau: float = 1e-4) -> DataFrame:
    """Per series the least order of differencing, on a grid, whose result passes the unit-root test at 5 %."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.log(frame.sort_values(order)[price].to_numpy(float))
        for d in np.round(np.arange(0.05, 1.0001, 0.05), 2):
            w = _weights(d, len(x))
            w = w[: max(2, int((np.abs(w) >= tau).sum()))]
            out = np.convolve(x, w, "valid")
            if len(out) >= 30 and (stat := adf_statistic(out)) < cut:
                return pd.DataFrame({key: [frame[key].iloc[0]], "d_star": [float(d)], "statistic": [stat]})
        return pd.DataFrame({key: [frame[key].iloc[0]], "d_star": [1.0], "statistic": [float("nan")]})

    return df.select(key, order, price).groupBy(key).applyInPandas(fit, f"{key} string, d_star double, statistic double")


def regime(df: DataFrame, key: str, order: str, x: str, rounds: int = 30) -> DataFrame:
    """Per series the filtered chance of the state with the higher mean, in a two-state Gaussian hidden Markov model."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        v = frame[x].to_numpy(float)
        mu, sd = np.quantile(v, [0.25, 0.75]), np.full(2, v.std() + 1e-9)
        step, start = np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5])
        alpha = np.zeros((len(v), 2))
        for _ in range(rounds):
            like = np.exp(-0.5 * ((v[:, None] - mu) / sd) ** 2) / sd + 1e-300
            scale = np.zeros(len(v))
            beta = np.ones((len(v), 2))
            for t in range(len(v)):
                a = (start if t == 0 else alpha[t - 1] @ step) * like[t]
                scale[t] = a.sum()
                alpha[t] = a / scale[t]
            for t in range(len(v) - 2, -1, -1):
                beta[t] = step @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            xi = step * (alpha[:-1].T @ (like[1:] * beta[1:] / scale[1:, None]))
            step, start = xi / xi.sum(axis=1, keepdims=True), gamma[0]
            weight = gamma.sum(axis=0) + 1e-12
            mu = (gamma * v[:, None]).sum(axis=0) / weight
            sd = np.sqrt((gamma * (v[:, None] - mu) ** 2).sum(axis=0) / weight) + 1e-9
        return pd.DataFrame({key: frame[key], order: frame[order], "prob_bull": alpha[:, int(mu[1] > mu[0])]})

    kinds = dict(df.dtypes)
    return df.select(key, order, x).where(F.col(x).isNotNull()).groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, {order} {kinds[order]}, prob_bull double")
