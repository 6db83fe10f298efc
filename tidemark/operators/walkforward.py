"""Models refit along a series: a row is scored only by what the rows before it teach.

A group is one series of a row per day, bounded by the length of its history; aggregate to days before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.learning import _weights, isotonic


def _per_series(df: DataFrame, key: str, order: str, columns: list[str], out: str, score) -> DataFrame:
    """Adds the columns of ``out`` that ``score`` gives for the sorted frame of a series."""
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        return pd.concat([frame[[key, order]], score(frame)], axis=1)

    return df.select(key, order, *columns).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {out}")


def isotonic_walk_forward(df: DataFrame, key: str, order: str, x: str, y: str, least: int = 60, every: int = 21, decay_days: int = 180) -> DataFrame:
    """(key, order, calibrated): each row by the isotonic fit of the rows before the last refit.

    A series is first fit before its row ``least`` and again every ``every`` rows; weights fall with the days before the
    last row learnt. Rows without finite x or y are not learnt. Rows before the first fit, and those without finite x, get null.
    """

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        raw, won = frame[x].to_numpy(float), frame[y].to_numpy(float)
        days = pd.to_datetime(frame[order]).to_numpy("datetime64[D]").astype(float)
        good, out, knots = np.isfinite(raw) & np.isfinite(won), np.full(len(frame), np.nan), None
        for t in range(least, len(frame)):
            if (t - least) % every == 0 and good[:t].any():
                seen = good[:t]
                weight = np.maximum(np.exp(-(days[t - 1] - days[:t][seen]) / max(decay_days, 1)), 1e-6)
                at, where = np.unique(raw[:t][seen], return_inverse=True)
                total = np.bincount(where, weight)
                knots = at, isotonic(np.bincount(where, weight * won[:t][seen]) / total, total)
            if knots is not None and np.isfinite(raw[t]):
                out[t] = np.interp(raw[t], *knots)
        return pd.DataFrame({"calibrated": out}).astype(object).where(np.isfinite(out)[:, None], None)

    return _per_series(df, key, order, [x, y], "calibrated double", score)


def _likelihoods(v: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> list[list[float]]:
    return (np.exp(-0.5 * ((v[:, None] - mu) / sd) ** 2) / sd + 1e-300).tolist()


def _forward(like: list[list[float]], step: list[list[float]], start: list[float]) -> tuple[list[tuple[float, float]], list[float]]:
    """Filtered chances of two states and the scale of each row."""
    (s00, s01), (s10, s11) = step
    a, b = start
    out, scales = [], []
    for k, (l0, l1) in enumerate(like):
        if k:
            a, b = a * s00 + b * s10, a * s01 + b * s11
        a, b = a * l0, b * l1
        scale = a + b
        a, b = a / scale, b / scale
        out.append((a, b))
        scales.append(scale)
    return out, scales


def _em(v: np.ndarray, model: tuple, rounds: int) -> tuple[tuple, np.ndarray]:
    """A two-state Gaussian chain after some rounds of expectation-maximisation, and the smoothed chances of the last."""
    mu, sd, step, start = model
    smooth = np.full((len(v), 2), 0.5)
    for _ in range(rounds):
        like = _likelihoods(v, mu, sd)
        alpha, scales = _forward(like, step.tolist(), start.tolist())
        (s00, s01), (s10, s11) = step.tolist()
        back = [(1.0, 1.0)]
        for (l0, l1), scale in zip(like[:0:-1], scales[:0:-1]):
            p, q = l0 * back[-1][0] / scale, l1 * back[-1][1] / scale
            back.append((s00 * p + s01 * q, s10 * p + s11 * q))
        alpha, beta, like = np.array(alpha), np.array(back[::-1]), np.array(like)
        smooth = alpha * beta
        smooth /= smooth.sum(axis=1, keepdims=True)
        moves = step * (alpha[:-1].T @ (like[1:] * beta[1:] / np.array(scales)[1:, None])) + 1e-12
        step, start = moves / moves.sum(axis=1, keepdims=True), smooth[0]
        weight = smooth.sum(axis=0) + 1e-12
        mu = (smooth * v[:, None]).sum(axis=0) / weight
        sd = np.sqrt((smooth * (v[:, None] - mu) ** 2).sum(axis=0) / weight) + 1e-6
    return (mu, sd, step, start), smooth


def _best_cut(p: np.ndarray, up: np.ndarray) -> float:
    """The threshold in 0.2 .. 0.8 with the highest F1, the lowest of equals; 0.5 if none finds a row."""
    best, cut = 0.0, 0.5
    for at in np.linspace(0.20, 0.80, 25):
        said = p > at
        if said.any() and (f1 := 2 * (said & up).sum() / (said.sum() + up.sum())) > best:
            best, cut = f1, float(at)
    return cut


def regime_walk_forward(df: DataFrame, key: str, order: str, x: str, least: int = 126, every: int = 21, context: int = 42, rounds: int = 30, again: int = 5) -> DataFrame:
    """(key, order, prob_bull, is_bull): the state with the higher mean, by a two-state chain refit on the rows before.

    The first fit takes ``rounds`` rounds, a refit starts from the last fit and takes ``again``. A row is filtered through the
    last ``context`` rows. Rows before the first fit have no chance and are not bull, as all rows of shorter series; rows
    without x are left out.
    """

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame[x].to_numpy(float)
        prob, bull, model, cut = np.full(len(v), np.nan), np.zeros(len(v), bool), None, 0.5
        for t in range(least, len(v)):
            if (t - least) % every == 0:
                past = v[:t]
                fresh = np.quantile(past, [0.25, 0.75]), np.full(2, past.std() + 1e-6), np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
                model, smooth = _em(past, model or fresh, again if model else rounds)
                cut = _best_cut(smooth[:, int(model[0][1] > model[0][0])], past > 0)
            mu, sd, step, start = model
            seen, _ = _forward(_likelihoods(v[max(0, t - context + 1) : t + 1], mu, sd), step.tolist(), start.tolist())
            prob[t] = seen[-1][int(mu[1] > mu[0])]
            bull[t] = prob[t] > cut
        chance = pd.Series(prob).astype(object).where(np.isfinite(prob), None)
        return pd.DataFrame({"prob_bull": chance, "is_bull": bull})

    return _per_series(df.where(df[x].isNotNull()), key, order, [x], "prob_bull double, is_bull boolean", score)


def _unit_root_path(z: np.ndarray, least: int = 30) -> np.ndarray:
    """For every n the unit-root statistic of the first n values (one lagged step, a constant), null below ``least``."""
    out = np.full(len(z) + 1, np.nan)
    if len(z) < least:
        return out
    z = z - z[:least].mean()  # the statistic does not depend on the level
    dx = np.diff(z)
    y, cols = dx[1:], np.column_stack([z[1:-1], dx[:-1], np.ones(len(dx) - 1)])
    gram, cross, squares = np.cumsum(cols[:, :, None] * cols[:, None, :], axis=0), np.cumsum(cols * y[:, None], axis=0), np.cumsum(y * y)
    rows = np.arange(1, len(y) + 1)
    ok = rows >= least - 2
    inverse = np.linalg.pinv(gram[ok], hermitian=True)
    beta = np.einsum("nij,nj->ni", inverse, cross[ok])
    left = np.maximum(squares[ok] - np.einsum("ni,ni->n", beta, cross[ok]), 0.0)
    variance = left / np.maximum(1, rows[ok] - 3) * inverse[:, 0, 0]
    out[2:][1:][ok] = beta[:, 0] / np.sqrt(np.maximum(variance, 1e-300))
    return out


def optimal_d_expanding(df: DataFrame, key: str, order: str, price: str, least: int = 252, tau: float = 1e-5, cut: float = -2.86) -> DataFrame:
    """(key, order, d_star): per row the least order of differencing, on a grid, that made the rows before it stationary at 5 %.

    Differencing looks back only, so each order is applied once and its statistics on all prefixes come from running
    sums. An order whose weights leave fewer than 30 values does not count; if none passes d is 1. Rows before ``least``
    take the first d of the series; shorter series have none.
    """

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.log(frame[price].to_numpy(float))
        best = np.full(len(x), np.nan)
        best[least:] = 1.0
        for d in np.round(np.arange(1.0, 0.04, -0.05), 2):
            w = _weights(d, len(x))
            small = np.flatnonzero(np.abs(w) < tau)
            w = w[: max(1, small[0])] if len(small) else w
            path = _unit_root_path(np.convolve(x, w, "valid"))
            # before row t there are t - len(w) + 1 differenced values
            have = np.arange(least, len(x)) - len(w) + 1
            stat = np.where(have >= 30, path[np.clip(have, 0, len(path) - 1)], np.nan)
            best[least:][stat < cut] = d
        if len(x) > least:
            best[:least] = best[least]
        return pd.DataFrame({"d_star": pd.Series(best).astype(object).where(np.isfinite(best), None)})

    return _per_series(df, key, order, [price], "d_star double", score)
