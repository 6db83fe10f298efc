"""Operators on small literal cases."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sizing, text
from tidemark.operators import learning, panel, policy, unlocks, walkforward, windows
from tidemark.sources.views import keep_last, upsert
from tidemark.streaming import acceptance


def test_percent_rank(spark):
    """Ranks are those of a plain average-rank count; nulls have none, a lone value ranks 0.5."""
    groups = {1: [4.0, 2.0, 2.0, 9.0, None, 2.0], 2: [5.0, None], 3: [None], 4: [1.0, 1.0]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    for r in df.select("*", windows.percent_rank_average(F.col("v"), ["g"]).alias("r")).collect():
        seen = [v for v in groups[r.g] if v is not None]
        expected = None if r.v is None else 0.5 if len(seen) == 1 else (sum(v < r.v for v in seen) + (sum(v == r.v for v in seen) - 1) / 2) / (len(seen) - 1)
        assert r.r == (expected if expected is None else pytest.approx(expected))


BUCKETS = {
    "Team/Founders": ["Founders / Team", "core_contributors", "Contributor sale", "dev team wallet", "Employee options"],
    "VC/Investors": ["public investors", "Backers", "Series-A", "STRATEGIC", "launchpad round", "IEO tranche", "private placement"],
    "Ecosystem": ["Rewards", "grants", "Incentives", "treasury reserve", "ecosystem growth"],
    "Airdrop/Public": ["ICO", "Launchpad", "community", "Public seed round", "community rewards", "testnet users", "Liquidity-Mining", "user reward pool"],
    "Other": ["", None, "misc", "vested", "video"],
}


def test_bucket_rules(spark):
    rows = [(x, name) for name, labels in BUCKETS.items() for x in labels]
    got = spark.createDataFrame(rows, "x string, b string").select("x", "b", text.bucket(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in got] == rows


def test_unlock_pressure(spark):
    """Weighted tokens of the 30 days after a date over supply, against a plain sum."""
    weights = {"Advisors": 1.5, "backers": 1.2, "grants": 0.8, "ICO": 0.6, "misc": 0.0}
    events = [(1, 3 + 9 * k, label, 7.0 + k) for k, label in enumerate([*weights, *weights])]
    ev = spark.createDataFrame(events, "asset long, n int, raw_label string, tokens double").withColumn("event_date", F.date_add(F.lit("2023-03-01").cast("date"), F.col("n")))
    at = spark.createDataFrame([(1, 0, 200.0), (1, 12, 200.0), (1, 40, 0.0), (2, 0, 5.0)], "asset long, n int, circ double").withColumn("as_of", F.date_add(F.lit("2023-03-01").cast("date"), F.col("n")))
    got = {(r.asset, r.n): r.ups_raw for r in unlocks.pressure(at, ev).join(at, ["asset", "as_of"]).collect()}
    for n in (0, 12):
        assert got[1, n] == pytest.approx(sum(weights[e[2]] * e[3] for e in events if n < e[1] <= n + 30) / 200)
    assert got[1, 40] is None and got[2, 0] == 0


def test_path_over_a_hot_key(spark):
    """Levels and tops of two keys, one with nearly all rows, against a plain walk."""
    from tidemark.operators.prefix import running_path

    df = spark.range(400).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.lit(None)).alias("k"), "id", F.when(F.col("id") % 13 > 0, (F.col("id") * 37 % 21 - 10) / 7).alias("v")).repartition(3)
    got = running_path(df, ["k"], [F.col("id")], "v", "level", "top").collect()
    at = {}
    for r in sorted(got, key=lambda r: r.id):
        level, top = at.get(r.k, (0.0, 0.0))
        level += r.v or 0.0
        at[r.k] = level, max(top, level)
        assert (r.level, r.top) == pytest.approx(at[r.k])
    assert len(got) == 400 and running_path(df.limit(0), ["k"], [F.col("id")], "v", "level", "top").count() == 0


def test_prefix_runs_over_a_hot_key(spark):
    from tidemark.operators.prefix import running

    df = spark.range(500).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.lit(None)).alias("k"), "id", (F.col("id") * 7 % 31).alias("v")).repartition(3)
    got = running(df, ["k"], [F.col("id")], {"total": (F.sum, "v", 0), "top": (F.max, "v", None)}).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.id):
        before = seen.setdefault(r.k, [])
        assert (r.total, r.top) == (sum(before), max(before, default=None))
        before.append(r.v)
    assert len(got) == 500


def test_no_division_by_zero(spark):
    """One class, constant columns, zero sums, zero prices, and fewer rows than folds give nulls or bounds, not errors."""
    from tidemark.operators import information

    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert information.auc(one, "s", F.col("y") == 1, []).first().auc is None
    assert information.vi_matrix(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), ["a", "b"]).first().vi == 1
    zero = spark.createDataFrame([(1, "team", 0.0), (1, "misc", 0.0)], "asset int, raw_label string, tokens double")
    assert tuple(unlocks.insider_share(zero).first()) == (1, None, 0.0)
    prices = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 3.0)], "k string, t int, p double")
    assert [r.r for r in prices.select(windows.log_return(F.col("p"), windows.series(["k"], "t")).alias("r")).collect()] == [None, None]
    few = spark.createDataFrame([(k, k, "a") for k in range(3)], "row_id long, date int, symbol string")
    assert sorted((r.pos, r.fold) for r in policy.purged_folds(few, 5, 0.01).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert policy.purged_folds(few.limit(0), 5, 0.01).count() == 0
    assert spark.range(1).select(sizing.drawdown_scalar(F.lit(1.0), F.lit(0.0)).alias("s"), unlocks.proxy_fallback(F.lit(1.0), F.lit(0.0), F.lit(0.1)).alias("p")).first() == (1.0, None)
    assert panel.calibration_error(spark.createDataFrame([], "p double"), "p", F.col("p") > 1, 10, True).first().ece is None


def test_fracdiff_weights():
    assert [len(windows.fracdiff_weights(d)) for d in (0.4, 0.9, 1.0)] == [1458, 125, 2]
    assert min(abs(w) for w in windows.fracdiff_weights(0.4)) >= 1e-5


def test_best_capture(spark):
    rows = [("a", "2024-01-03 09:00", "text/html", 1), ("a", "2024-01-03 11:00", "application/pdf", 2), ("a", "2024-01-02 23:00", "text/html", 3), ("a", "2024-01-04 00:00", "text/html", 4), ("b", "2024-01-03 23:59", None, 5)]
    df = spark.createDataFrame(rows, "k string, at string, mime string, n int").withColumn("at", F.to_timestamp("at"))
    got = {r.k: r.n for r in unlocks.best_capture(df, "k", "at", "mime", F.lit("2024-01-03").cast("date")).collect()}
    assert got == {"a": 1, "b": 5}


ALARMS = [
    ((0.0, 0.1, False, True, "OPEN", "NONE", 0.5), 3), ((1.0, 0.21, False, True, "OPEN", "NONE", 0.5), 3), ((1.0, 0.1, True, True, "OPEN", "NONE", 0.5), 3), ((1.0, 0.1, False, False, "OPEN", "NONE", 0.5), 2),
    ((1.0, 0.1, False, True, "BLOCKED", "NONE", 0.5), 2), ((1.0, 0.1, False, True, "OPEN", "MODERATE", 0.5), 2), ((0.7, 0.1, False, True, "OPEN", "NONE", 0.5), 1), ((1.0, 0.17, False, True, "OPEN", "NONE", 0.5), 1),
    ((1.0, 0.19, False, True, "OPEN", "NONE", 0.5), 0), ((1.0, 0.1, False, True, "OPEN", "NONE", 0.53), 1), ((1.0, None, None, None, None, None, None), 0),
]


def test_alarm_levels(spark):
    df = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(ALARMS)], "i int, scalar double, cvar double, systemic boolean, bull boolean, breaker string, drift string, auc double")
    got = df.select("i", sizing.alarm_level(*[F.col(c) for c in df.columns[1:]]).alias("level")).orderBy("i").collect()
    assert [r.level for r in got] == [level for _, level in ALARMS]


def test_pre_trade_rules(spark):
    rows = [((0.18, 0.3, True, False, "BLOCKED", "SEVERE"), "drawdown", 3), ((0.1, 0.3, True, True, "OPEN", "NONE"), "cvar", 3), ((0.1, 0.1, True, False, "OPEN", "NONE"), "systemic_drift", 3), ((0.1, 0.1, False, False, "BLOCKED", "SEVERE"), "bear", 2),
            ((0.1, 0.1, False, True, "BLOCKED", "SEVERE"), "spread_breaker", 2), ((0.1, 0.1, False, True, "OPEN", "SEVERE"), "severe_drift", 2), ((0.1, 0.2, False, True, "OPEN", "MODERATE"), "moderate_drift", 1), ((0.1, 0.1, False, True, "OPEN", "NONE"), "drawdown_warning", 1), ((0.0, 0.1, False, True, "OPEN", "NONE"), "ok", 0)]
    df = spark.createDataFrame([(i, *a) for i, (a, _, _) in enumerate(rows)], "i int, dd double, cvar double, systemic boolean, bull boolean, breaker string, drift string")
    got = df.select("i", sizing.pre_trade(*[F.col(c) for c in df.columns[1:]], F.lit(100.0), F.lit(0.5)).alias("c")).select("i", "c.*").orderBy("i").collect()
    assert [(r.reason, r.level) for r in got] == [(why, level) for _, why, level in rows]
    assert [r.size for r in got] == pytest.approx([0.0] * 6 + [37.5, 50.0, 50.0])


def test_stablecoins(spark):
    rows = [("wbtc", "x", True), ("lusd", "x", True), ("LINK", "Chainlink", False), ("ABC", "abc pegged coin", True), ("SOL", "Solana", False)]
    df = spark.createDataFrame(rows, "s string, n string, out boolean")
    assert [r.got for r in df.select(text.is_stablecoin(F.col("s"), F.col("n")).alias("got")).collect()] == [r[2] for r in rows]


def test_ladder_turns_away(spark):
    rows = [("p", 1, 5, "x", 1, True, ["A"]), ("p", 2, 5, "x", 1, False, ["A"]), ("p", 3, 5, "x", 99, False, ["A", "B"]), ("p", 4, 5, "x", 1, False, ["B", "A"]), ("p", 5, 5, "x", 1, None, ["A", "B"]), ("p", 6, 5, "y", 1, False, ["A", "B"]), ("p", 7, 4, "x", 1, False, ["A", "B"]), ("p", 8, 6, "z", 1, False, None)]
    df = spark.createDataFrame(rows, "portfolio string, arrival long, revision long, fingerprint string, age_days int, expired boolean, instruments array<string>")
    got = acceptance.ladder(df, 10, ("A", "B")).orderBy("arrival").collect()
    assert [r.status for r in got] == ["stale", "incomplete", "stale", "accepted", "duplicate", "conflict", "out_of_order", "incomplete"]


def test_purge_span():
    from tidemark.plans.learning import purge_span

    assert purge_span(600, 6, 1, 3) == (94, 406) and purge_span(600, 6, 0, 5) == (0, 600) and purge_span(605, 6, 4, 5) == (394, 605)


def test_cooldown(spark):
    rows = [(k, "A", f"2024-01-0{d}") for k, d in enumerate((1, 2, 3, 5))]
    df = spark.createDataFrame(rows, "row_id long, symbol string, d string").withColumn("date", F.to_date("d"))
    assert sorted(r.row_id for r in policy.cooldown(df, "symbol", "date", "row_id", 3).collect()) == [0, 3]


def test_relative_target(spark):
    rows = [(1, "A", "c1", 0.03), (2, "B", "c1", 0.04), (3, "C", "c2", 0.05), (4, "D", "c2", -0.01)]
    df = spark.createDataFrame(rows, "row_id long, symbol string, cluster string, pnl double").withColumn("date", F.lit(1)).withColumn("avg_sl", F.lit(0.02))
    assert [r.target for r in policy.relative_target(df).orderBy("row_id").collect()] == [0, 1, 1, 0]


def test_ewm_is_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    values = [None if i % 17 == 5 else float(v) for i, v in enumerate(rng.normal(size=2300))]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "symbol string, ts int, x double")
    series = pd.Series(values, dtype=float)
    for std, expected in ((False, series.ewm(span=20, min_periods=5).mean()), (True, series.ewm(span=20, min_periods=5).std())):
        got = [r.out for r in windows.ewm(df, "symbol", "ts", "x", 20, 5, "out", std).orderBy("ts").select("out").collect()]
        for a, b in zip(got, expected):
            assert (a is None and math.isnan(b)) or a == pytest.approx(b, abs=1e-9)


def test_as_of_keeps_stored_nulls(spark):
    left = spark.createDataFrame([("s", 1), ("s", 3), ("s", 6)], "k string, t int")
    right = spark.createDataFrame([("s", 2, 1.0), ("s", 5, None)], "k string, t int, v double")
    assert [r.v for r in windows.as_of(left, right, "k", "t", ["v"]).orderBy("t").collect()] == [None, 1.0, None]


def test_keep_last_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1.0), (3, "d", 2.0)], "k int, v string, w double")
    assert {r.k: (r.v, r.w) for r in upsert(old, new, ["k"]).collect()} == {1: ("a", None), 2: ("c", 1.0), 3: ("d", 2.0)}
    assert keep_last(new.limit(0), ["k"], F.col("w")).count() == 0


def test_calibration_error_ends(spark):
    df = spark.createDataFrame([(1.0, 1), (0.05, 0), (0.05, 1)], "p double, y int")
    open_, closed = (panel.calibration_error(df, "p", F.col("y"), 10, c).first().ece for c in (False, True))
    assert open_ == pytest.approx(2 / 3 * 0.45) and closed == pytest.approx(2 / 3 * 0.45)


def test_isotonic():
    assert learning.isotonic(np.array([0.0, 0.6, 0.2, 0.9]), np.ones(4)).tolist() == pytest.approx([0.0, 0.4, 0.4, 0.9])


def test_normal_cdf(spark):
    got = spark.createDataFrame([(-2.0,), (0.0,), (1.0,)], "x double").select(sizing.normal_cdf(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in (-2.0, 0.0, 1.0)], abs=2e-7)


def test_deflated_sharpe_falls_with_trials():
    assert sizing.deflated_sharpe(0.35, 222, 0, 3, 500) > sizing.deflated_sharpe(0.35, 222, 0, 3, 5000)


def _daily(n, seed):
    rng = np.random.default_rng(seed)
    return rng, [(datetime.date(2020, 1, 1) + datetime.timedelta(i),) for i in range(n)]


def test_unit_root_of_prefixes():
    rng = np.random.default_rng(5)
    z = np.cumsum(rng.normal(size=150)) * 0.2 + rng.normal(size=150) + 40
    path = walkforward._unit_root_path(z)
    assert np.isnan(path[:30]).all()
    assert path[30:] == pytest.approx([learning.adf_statistic(z[:n]) for n in range(30, 151)], rel=1e-6)


def test_walk_forward_looks_back_only(spark):
    """Rows are scored alike whether later rows are there or not; the first rows and short series have no score."""
    rng, days = _daily(330, 3)
    r = np.where(np.arange(330) // 40 % 2, 0.02, -0.02) + rng.normal(0, 0.01, 330)
    rows = [("a", d[0], float(s), float(s + e > 0.5), float(x), float(c)) for d, s, e, x, c in zip(days, rng.random(330), rng.normal(0, 0.2, 330), r, 100 * np.exp(np.cumsum(r)))]
    rows += [("b", *row[1:]) for row in rows[:20]]
    df = spark.createDataFrame(rows, "k string, d date, s double, y double, r double, c double")
    for run, first, col in (
        (lambda t: walkforward.isotonic_walk_forward(t, "k", "d", "s", "y"), 60, "calibrated"),
        (lambda t: walkforward.regime_walk_forward(t, "k", "d", "r"), 126, "prob_bull"),
        (lambda t: walkforward.optimal_d_expanding(t, "k", "d", "c", tau=1e-2), 0, "d_star"),
    ):
        whole, cut = [{(x.k, x.d): x[col] for x in run(t).collect()} for t in (df, df.where(F.col("d") < days[280][0]))]
        assert len(whole) == 350 and all(whole[at] == v for at, v in cut.items())
        assert [i for i, d in enumerate(days) if whole["a", d[0]] is not None] == list(range(first, 330))
        assert all(v is None for (k, _), v in whole.items() if k == "b")
    bull = {x.d: x.is_bull for x in walkforward.regime_walk_forward(df.where("k = 'a'"), "k", "d", "r").collect()}
    assert np.mean([bull[d[0]] == (i // 40 % 2 == 1) for i, d in enumerate(days) if i >= 180]) > 0.85


def test_isotonic_walk_forward_by_hand(spark):
    rng, days = _daily(70, 8)
    x, y = rng.random(70), rng.integers(0, 2, 70).astype(float)
    df = spark.createDataFrame([("a", d[0], float(a), float(b)) for d, a, b in zip(days, x, y)], "k string, d date, x double, y double")
    got = {r.d: r.calibrated for r in walkforward.isotonic_walk_forward(df, "k", "d", "x", "y", decay_days=10**9).collect()}
    order = np.argsort(x[:60])
    fit = learning.isotonic(y[:60][order], np.ones(60))
    assert [got[d[0]] for d in days[60:]] == pytest.approx(list(np.interp(x[60:], x[:60][order], fit)), abs=1e-6)
