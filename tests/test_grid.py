"""The policy grid against a plain walk over sorted trades."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators.grid import Policy

START = datetime.date(2020, 1, 1)
POLICIES = [Policy("all", 0.1), Policy("fixed", 0.5, "fixed"), Policy("rest", 0.3, "conservative", cooldown=4), Policy("best", 0.2, "fixed", top_n=2, regime_min=0.4), Policy("cap", 0.0, "fixed", daily_cap=0.01), Policy("never", 2.0), Policy("both", 0.2, "fixed", cooldown=2, top_n=1)]


def rows(n=900, days=430):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        out.append((k, START + datetime.timedelta(int(rng.integers(days))), str(rng.choice(["a", "b", "c"])), float(rng.integers(0, 20)) / 20, float(rng.random()), float(rng.normal(0.01, 0.1)), float(rng.choice([0, 500, 3000, 90000]))))
    out += [(n + k, START + datetime.timedelta(k), "d", 0.0, 0.0, 0.0, 0.0) for k in range(days)]
    out += [(5000, None, "a", 0.9, 0.9, 1.0, 500.0), (5001, START, "a", None, 0.9, 1.0, 500.0), (5002, START, "a", 0.9, None, 3.0, None)]
    return out


def plain_trades(data, p):
    kept, last = [], {}
    own = sorted([r for r in data if r[1] and (r[3] or 0) > p.threshold and (p.regime_min is None or (r[4] or 0) >= p.regime_min)], key=lambda r: (r[1], -(r[3] or 0), r[0]))
    for r in own:
        if p.cooldown:
            if r[2] in last and (r[1] - last[r[2]]).days <= p.cooldown:
                continue
            last[r[2]] = r[1]
        kept.append(r)
    if p.most() is not None:
        seen = {}
        kept = [r for r in kept if seen.update({r[1]: seen.get(r[1], 0) + 1}) or seen[r[1]] <= p.most()]
    out = []
    for r in sorted(kept, key=lambda r: (r[1], r[2], r[0])):
        size = {"current": r[6] or 0, "fixed": 2000, "conservative": min((r[6] or 0) / 2, 4000)}[p.size]
        alloc = min(max(size / 200000, 0), 0.25)
        if alloc > 0.001:
            out.append((r[1], r[5], alloc, min(max(r[5], -0.5), 2) * alloc))
    return out


def plain_metrics(trades):
    if len(trades) < 5:
        return (len(trades), 0, 0, 0, 0, 0)
    ret = np.array([t[3] for t in trades])
    curve = np.concatenate([[1], np.cumprod(1 + ret)])
    fall = (1 - curve / np.maximum.accumulate(curve)).max()
    return (len(ret), ret.mean() / (ret.std() + 1e-10) * np.sqrt(50.4), curve[-1] - 1, fall, np.mean([t[1] > 0 for t in trades]), np.mean([t[2] for t in trades]))


def test_grid(spark):
    data = rows()
    df = spark.createDataFrame(data, "row_id long, date date, symbol string, score double, regime double, pnl double, position double").withColumns({"label": F.lit("old"), "size": F.lit("old")})
    metrics, spans = grid.grid_metrics(df.repartition(3), POLICIES)
    at = {s.span: s for s in spans.collect()}
    assert at["all"].n_days == 430 and at["holdout_train"].n_days + at["holdout_test"].n_days == 430 and at["holdout_test"].n_days == 90
    assert sorted(at) == ["all", "fold_1_test", "fold_1_train", "holdout_test", "holdout_train"]
    assert at["fold_1_test"].last == at["all"].last and (at["fold_1_test"].first - at["fold_1_train"].last).days == 1
    got = {(m.label, m.span): m for m in metrics.collect()}
    assert len(got) == len(POLICIES) * len(at)
    for p in POLICIES:
        trades = plain_trades(data, p)
        for name, s in at.items():
            want = plain_metrics([t for t in trades if s.first <= t[0] <= s.last])
            assert [got[p.label, name][c] for c in grid.METRICS] == pytest.approx(want, abs=1e-9), (p.label, name)
    ranked = sorted(POLICIES, key=lambda p: (-(m := got[p.label, "holdout_train"]).sharpe, -m.cum_return, m.max_dd, -m.n_active, p.label))
    picked = {r.split: r for r in grid.selection(metrics, "fixed").collect()}
    assert picked["holdout"].chosen == ranked[0].label and picked["holdout"].chosen_sharpe == got[ranked[0].label, "holdout_test"].sharpe and picked["holdout"].benchmark_sharpe == got["fixed", "holdout_test"].sharpe


def test_short_and_empty_tables(spark):
    df = spark.createDataFrame(rows(20, 30), "row_id long, date date, symbol string, score double, regime double, pnl double, position double")
    metrics, spans = grid.grid_metrics(df, POLICIES)
    assert [s.span for s in spans.collect()] == ["all"] and grid.selection(metrics, "fixed").count() == 0
    assert grid.grid_metrics(df.limit(0), POLICIES)[0].count() == 0
