"""Regimes of a series from several features: components that carry enough variance, and a chain of two states over them.

All is refit along the series on the rows before; a series is a group, bounded by its history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.walkforward import _best_cut, _forward, _per_series

#: Share of variance that components must carry, fewest and most of them, rows per parameter for full covariances.
VARIANCE, FEWEST, MOST, FULL = 0.85, 2, 5, 10
#: Least F1 out of sample, and least share of bear days in a span that is known to be one.
LEAST_F1, LEAST_BEAR = 0.45, 0.60


class Components:
    """Clipping at the 1 and 99 % points, scaling by median and quartiles, and the least number of components that carries enough variance."""

    def __init__(self, x: np.ndarray, variance: float = VARIANCE):
        self.low, self.high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
        clipped = np.clip(x, self.low, self.high)
        q1, self.middle, q3 = np.quantile(clipped, [0.25, 0.5, 0.75], axis=0)
        self.spread = np.where(q3 - q1 > 0, q3 - q1, 1.0)
        scaled = (clipped - self.middle) / self.spread
        self.mean = scaled.mean(axis=0)
        _, s, vt = np.linalg.svd(scaled - self.mean, full_matrices=False)
        share = s**2 / max(float((s**2).sum()), 1e-300)
        needed = int(np.searchsorted(np.cumsum(share), variance - 1e-12)) + 1
        self.k = min(len(s), max(FEWEST, min(needed, MOST)))
        self.explained = float(share[: self.k].sum())
        signs = np.sign(vt[: self.k][np.arange(self.k), np.abs(vt[: self.k]).argmax(axis=1)])
        self.axes = vt[: self.k] * np.where(signs == 0, 1, signs)[:, None]  # the largest weight of an axis is positive

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((np.clip(x, self.low, self.high) - self.middle) / self.spread - self.mean) @ self.axes.T


class Chain:
    """Two states with Gaussian scores: full covariances where the rows allow it, else only variances."""

    def __init__(self, x: np.ndarray, rounds: int = 30):
        n, k = x.shape
        self.full = n / (2 * (k + k * (k + 1) // 2) + 2) >= FULL
        self.centre, self.unit = x.mean(axis=0), np.where(x.std(axis=0) < 1e-8, 1.0, x.std(axis=0))
        z = (x - self.centre) / self.unit
        high = z[:, 0] > np.median(z[:, 0])
        self.mu = np.array([z[~high].mean(axis=0) if (~high).any() else -np.ones(k), z[high].mean(axis=0) if high.any() else np.ones(k)])
        self.cov = np.array([np.eye(k)] * 2)
        self.step, self.start = np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
        self.smooth = np.full((n, 2), 0.5)
        for _ in range(rounds):
            self._round(z)

    def _like(self, z: np.ndarray) -> np.ndarray:
        logs = []
        for m, c in zip(self.mu, self.cov):
            d = z - m
            logs.append(-0.5 * (np.einsum("ij,ij->i", d @ np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
        logs = np.array(logs).T
        return np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-300

    def _round(self, z: np.ndarray) -> None:
        like = self._like(z)
        alpha, scales = _forward(like.tolist(), self.step.tolist(), self.start.tolist())
        beta = np.ones_like(like)
        for t in range(len(z) - 2, -1, -1):
            beta[t] = self.step @ (like[t + 1] * beta[t + 1]) / scales[t + 1]
        alpha = np.array(alpha)
        self.smooth = alpha * beta
        self.smooth /= self.smooth.sum(axis=1, keepdims=True)
        moves = self.step * (alpha[:-1].T @ (like[1:] * beta[1:] / np.array(scales)[1:, None])) + 1e-12
        self.step, self.start = moves / moves.sum(axis=1, keepdims=True), self.smooth[0]
        weight = self.smooth.sum(axis=0) + 1e-12
        self.mu = (self.smooth.T @ z) / weight[:, None]
        for s in range(2):
            d = z - self.mu[s]
            c = (d * self.smooth[:, s : s + 1]).T @ d / weight[s]
            self.cov[s] = (c if self.full else np.diag(np.diag(c))) + 1e-3 * np.eye(z.shape[1])

    def filtered(self, x: np.ndarray) -> np.ndarray:
        seen, _ = _forward(self._like((x - self.centre) / self.unit).tolist(), self.step.tolist(), self.start.tolist())
        return np.array(seen)


def _rising(returns: np.ndarray, smooth: np.ndarray) -> int:
    """The state whose rows had the higher mean return; states of fewer than five rows count least."""
    state = smooth.argmax(axis=1)
    means = [float(np.nanmean(returns[state == s])) if (state == s).sum() >= 5 and np.isfinite(returns[state == s]).any() else -999.0 for s in (0, 1)]
    return int(np.argmax(means))


def component_regimes(df: DataFrame, key: str, order: str, features: list[str], ret: str, least: int = 126, every: int = 21, context: int = 42, rounds: int = 20) -> DataFrame:
    """(key, order, n_components, explained, prob_bull, is_bull) of every row of each series of ``df``.

    Every ``every`` rows components and chain are fit on all rows before that have all features, ``least`` at least. The
    bull state is the one whose rows had the higher mean return, and its threshold the one with the best F1 against
    returns above 0 on those rows. A row is filtered through the last ``context`` rows; it has no chance and is not bull
    where one of them lacks a feature, or before the first fit. Later rows change nothing.
    """

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        x, r = frame[features].to_numpy(float), frame[ret].to_numpy(float)
        whole = np.isfinite(x).all(axis=1)
        n = len(x)
        prob, bull, count, share = np.full(n, np.nan), np.zeros(n, bool), np.full(n, np.nan), np.full(n, np.nan)
        model = None
        for t in range(least, n):
            if (t - least) % every == 0 and whole[:t].sum() >= least:
                past = x[:t][whole[:t]]
                parts = Components(past)
                chain = Chain(parts.scores(past), rounds)
                own = r[:t][whole[:t]]
                up = _rising(own, chain.smooth)
                model = parts, chain, up, _best_cut(chain.smooth[np.isfinite(own), up], own[np.isfinite(own)] > 0)
            lo = max(0, t - context + 1)
            if model is None:
                continue
            parts, chain, up, cut = model
            count[t], share[t] = parts.k, parts.explained
            if whole[lo : t + 1].all():
                prob[t] = chain.filtered(parts.scores(x[lo : t + 1]))[-1, up]
                bull[t] = prob[t] > cut
        out = pd.DataFrame({"n_components": count, "explained": share, "prob_bull": prob})
        return out.astype(object).where(out.notna(), None).assign(is_bull=bull)

    return _per_series(df, key, order, list(dict.fromkeys([*features, ret])), "n_components int, explained double, prob_bull double, is_bull boolean", score)


def component_health(df: DataFrame, key: str, order: str, features: list[str], crash: str) -> DataFrame:
    """(key, order, z_plain, z_robust, contaminated, robust_ok) of the rows of ``df`` marked ``crash`` (boolean).

    How far such a row lies from the mean along the first component, in deviations: of plainly standardised features and of
    clipped and robustly scaled ones. Series with fewer than three whole rows have none.
    """

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[features].to_numpy(float)
        whole = np.isfinite(x).all(axis=1)
        z = np.full((len(x), 2), np.nan)
        if whole.sum() >= 3:
            own = x[whole]
            plain = (own - own.mean(axis=0)) / np.where(own.std(axis=0) > 0, own.std(axis=0), 1.0)
            first = plain @ np.linalg.svd(plain, full_matrices=False)[2][0]
            robust = Components(own).scores(own)[:, 0]
            z[whole] = np.column_stack([(v - v.mean()) / (v.std() + 1e-10) for v in (first, robust)])
        out = pd.DataFrame({"z_plain": np.abs(z[:, 0]), "z_robust": np.abs(z[:, 1])})
        return out.astype(object).where(out.notna(), None).assign(crash=frame[crash].fillna(False).to_numpy(bool))

    rows = _per_series(df, key, order, [*features, crash], "z_plain double, z_robust double, crash boolean", check).where("crash and z_plain is not null")
    return rows.drop("crash").withColumns({"contaminated": F.col("z_plain") > 5, "robust_ok": F.col("z_robust") <= 3})


def regime_report(rows: DataFrame, keys: list[str], ret: str, bear_span: Column) -> DataFrame:
    """(keys, f1, bear_share, f1_ok, bear_ok, status) of regimes (prob_bull, is_bull, ret) out of sample.

    F1 is against returns above 0 and needs more than 30 rows with a chance and a return; the share of bear days is over the
    rows of ``bear_span``. What can't be judged fails nothing.
    """
    judged = F.col("prob_bull").isNotNull() & F.col(ret).isNotNull()
    up, said = F.col(ret) > 0, F.coalesce("is_bull", F.lit(False))
    both, some = F.count_if(judged & up & said), F.count_if(judged & up) + F.count_if(judged & said)
    one = rows.groupBy(*keys).agg(F.count_if(judged).alias("_n"), both.alias("_b"), some.alias("_s"), F.avg(F.when(bear_span, (~said).cast("double"))).alias("bear_share"))
    one = one.withColumn("f1", F.when(F.col("_n") > 30, F.coalesce(F.try_divide(2 * F.col("_b"), F.col("_s")), F.lit(0.0))))
    one = one.withColumns({"f1_ok": F.col("f1") >= LEAST_F1, "bear_ok": F.col("bear_share") >= LEAST_BEAR})
    good = F.coalesce("f1_ok", F.lit(True)) & F.coalesce("bear_ok", F.lit(True))
    return one.select(*keys, "f1", "bear_share", "f1_ok", "bear_ok", F.when(good, "PASS").otherwise("FAIL").alias("status"))
