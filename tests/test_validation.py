"""Cross-validation, regimes, sizes and ratios against plain forms."""

import datetime
import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crossval, learning, portfolio, regimes

# cross-validation


@pytest.mark.parametrize("n,folds,embargo", [(100, 6, 1), (17, 5, 3), (200, 4, 0)])
def test_bounds_and_purges(n, folds, embargo):
    """Folds are those of an even split; each purge leaves out exactly its folds, their neighbours, and with a span what lies between."""
    parts = np.array_split(np.arange(n), folds)
    assert [list(range(lo, hi)) for lo, hi in crossval.bounds(n, folds)] == [p.tolist() for p in parts]
    for path in combinations(range(folds), 2):
        each = set()
        for k in path:
            each |= {x for x in range(parts[k][0] - embargo, parts[k][-1] + embargo + 1) if 0 <= x < n}
        test = np.concatenate([parts[k] for k in path])
        whole = {x for x in range(test.min() - embargo, test.max() + embargo + 1) if 0 <= x < n}
        got = [{x for lo, hi in crossval.purged(n, folds, path, embargo, span) for x in range(lo, hi)} for span in (False, True)]
        assert got == [each, whole] and each <= whole


def test_path_roles(spark):
    rows = spark.range(120).select(F.col("id").alias("pos"), F.lit("x").alias("keep"))
    got = crossval.path_roles(rows, 120, folds=4, embargo=0.05).collect()
    for name, (gone, held, train) in crossval.paths(120, 4, 2, 0.05, False).items():
        own = [r for r in got if r.path == name]
        assert sum(r.role == "train" for r in own) == train
        assert all((r.role == "test") == any(lo <= r.pos < hi for lo, hi in held) for r in own)
        assert not any(lo <= r.pos < hi for lo, hi in gone for r in own if r.role == "train")
    assert crossval.path_roles(rows.limit(10), 10).count() == 0


def test_a_model_never_sees_what_is_near(spark):
    """Training rows of every path are those that neither purge takes; predictions cover each test row once."""
    rows = spark.range(300).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    seen = []

    def fit(train):
        seen.append({r.pos for r in train.collect()})
        return lambda part: part.withColumn("p", F.col("y") * 0.5 + F.col("pos") % 7 / 100)

    for span in (False, True):
        seen.clear()
        out = crossval.cross_predictions(rows, fit, span=span).collect()
        kept = crossval.paths(300, 6, 2, 0.01, span)
        assert len(seen) == len(kept) == (14 if span else 15)
        for train, (name, (gone, held, _)) in zip(seen, kept.items()):
            assert train == {x for x in range(300) if not any(lo <= x < hi for lo, hi in gone)}
            assert sorted(r.pos for r in out if r.path == name) == [x for lo, hi in held for x in range(lo, hi)]
    assert crossval.cross_predictions(rows.limit(20), fit) is None


def test_verdict(spark):
    good = [(f"p{k}", 100, i / 40, int(i >= 20)) for k in range(10) for i in range(40)]
    bad = [("q", 100, i / 40, int(i < 20)) for i in range(40)] + [("one", 100, 0.5, 1) for _ in range(20)]
    rows = lambda data: crossval.verdict(spark.createDataFrame(data, "path string, n_train int, p double, y int")).collect()
    one = {r.path: r for r in rows(good)}
    assert one["all"].status == "PASS" and one["all"].n == 10 and one["all"].overfit == 0 and one["p3"].auc == 1.0 and one["p3"].status == "beats_chance"
    two = {r.path: r for r in rows(good + bad)}
    assert two["q"].auc == 0 and two["one"].auc == 0.5 and two["all"].overfit == pytest.approx(1 / 12) and two["all"].low_share == pytest.approx(2 / 12) and two["all"].status == "PASS"
    assert {r.path: r for r in rows(good[:120] + bad)}["all"].status == "FAIL"
    assert rows([])  == []


def test_cluster_calibration(spark):
    """Clusters of enough rows have their own curve, others that of all rows; a chance of 0 stays."""
    rng = np.random.default_rng(1)
    p = rng.random(1200).round(3)
    cluster = np.where(np.arange(1200) < 50, "small", np.where(np.arange(1200) % 2 == 0, "a", "b"))
    y = (rng.random(1200) < np.where(cluster == "a", p**2, np.sqrt(p))).astype(int)
    day = datetime.date(2024, 1, 1)
    data = [(k, str(cluster[k]), float(p[k]), int(y[k]), day) for k in range(1200)] + [(9999, "a", 0.0, 1, day)]
    df = spark.createDataFrame(data, "row_id int, cluster string, p double, y int, date date")
    out, report = portfolio.cluster_calibrated(df, "row_id", "cluster", "p", "y", "date", learning.isotonic)
    got = {r.row_id: r.calibrated for r in out.collect()}
    assert len(got) == 1201 and got[9999] == 0.0
    by = {r.cluster: r for r in report.collect()}
    assert by["small"].mode == "global" and by["a"].mode == by["b"].mode == "own" and by["a"].gap_after < by["a"].gap_before
    for name, own in (("a", [r for r in data if r[1] == "a"]), ("small", data)):
        points = {}
        for r in own:
            points.setdefault(round(min(max(r[2], 0.001), 0.999), 4), []).append(r[3])
        x = sorted(points)
        fitted = dict(zip(x, learning.isotonic(np.array([np.mean(points[v]) for v in x]), np.array([float(len(points[v])) for v in x]))))
        for r in data:
            if r[1] == name and r[2] > 0:
                assert got[r[0]] == pytest.approx(fitted[round(min(max(r[2], 0.001), 0.999), 4)], abs=1e-9)


# regimes


def test_component_count():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 6)) * [10, 8, 1, 1, 1, 1]
    x = base @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    assert regimes.Components(x, 0.3).k == 2 and regimes.Components(x, 1.0).k == 5 and 0.85 <= regimes.Components(x, 0.85).explained <= 1
    one = regimes.Components(np.column_stack([base[:, 0]] * 3 + [base[:, 1] * 1e-3]))
    assert one.k == 2
    parts = regimes.Components(x)
    scaled = (np.clip(x, parts.low, parts.high) - parts.middle) / parts.spread
    values = np.sort(np.linalg.eigvalsh(np.cov(scaled.T)))[::-1]
    shares = np.cumsum(values) / values.sum()
    assert parts.k == min(5, max(2, int(np.argmax(shares >= 0.85)) + 1)) and parts.explained == pytest.approx(shares[parts.k - 1])


def series(seed, n=360):
    rng = np.random.default_rng(seed)
    state = (np.arange(n) // 45) % 2
    r = np.where(state == 1, 0.02, -0.02) + 0.01 * rng.normal(size=n)
    a = np.where(state == 1, 2.0, -2.0)[:, None] + 0.6 * rng.normal(size=(n, 3))
    return state, [("s", k, float(r[k]), *map(float, a[k])) for k in range(n)]


def test_component_regimes(spark):
    """The planted states are found, and rows that come later change nothing."""
    state, rows = series(3)
    rows[200] = (*rows[200][:3], None, 1.0, 1.0)
    schema = "symbol string, d int, r double, a double, b double, c double"
    run = lambda data: {x.d: x for x in regimes.component_regimes(spark.createDataFrame(data, schema), "symbol", "d", ["a", "b", "c"], "r", least=120, every=40, context=20, rounds=10).collect()}
    got = run(rows)
    seen = [k for k in range(130, 360) if got[k].prob_bull is not None]
    assert np.mean([got[k].is_bull == bool(state[k]) for k in seen]) > 0.9 and all(got[k].prob_bull is None and not got[k].is_bull for k in [*range(120), *range(200, 220)])
    assert {got[k].n_components for k in range(121, 360)} <= {2, 3, 4, 5}
    short = run(rows[:300])
    assert all(short[k] == got[k] for k in range(300))
    assert run(rows[:100])[50].prob_bull is None


def test_component_health(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[77] = 60.0
    rows = [("s", k, *map(float, x[k]), k in (77, 100)) for k in range(300)] + [("t", 0, 1.0, 1.0, None, True)]
    got = {r.d: r for r in regimes.component_health(spark.createDataFrame(rows, "symbol string, d int, a double, b double, c double, crash boolean"), "symbol", "d", ["a", "b", "c"], "crash").collect()}
    assert set(got) == {77, 100} and got[77].contaminated and got[77].z_robust < got[77].z_plain / 2 and not got[100].contaminated and got[100].robust_ok


def test_regime_report(spark):
    rows = [("s", k, 0.5 if k < 60 else None, k % 2 == 0, 1.0 if k % 2 == 0 else -1.0) for k in range(70)] + [("few", k, 0.5, True, 1.0) for k in range(5)]
    got = {r.symbol: r for r in regimes.regime_report(spark.createDataFrame(rows, "symbol string, d int, prob_bull double, is_bull boolean, r double"), ["symbol"], "r", F.col("d") < 10).collect()}
    assert got["s"].f1 == 1.0 and got["s"].bear_share == 0.5 and got["s"].status == "FAIL" and got["few"].f1 is None and got["few"].status == "FAIL"


# sizes


def plain_size(p, sigma, capital, peak, symbol, held):
    mu = p * 1.5 * sigma - (1 - p) * 1.5 * sigma
    scalar = max(0, 1 - max(1 - capital / peak, 0) / 0.18)
    if p <= 0.51 or mu <= 0 or scalar == 0:
        return 0.0
    kelly = min((NormalDist().cdf((p - 0.5) / 0.1) - 0.5) * 2 * 0.08, min(0.25 * mu / max(sigma**2, 1e-8), 0.08))
    size = kelly * capital * scalar
    cvar = lambda q: portfolio.TAIL_LOSS * sum(w * s for w, s in ({k: v for k, v in held.items() if k != symbol} | {symbol: (q / capital, sigma)}).values())
    if cvar(size) > 0.15:
        size *= 0.15 / cvar(size)
    return min(max(size, 50), 10_000)


def test_position_sizes(spark):
    """A size shrinks with what the rest of the portfolio holds; its own symbol's position is replaced."""
    held = {"a": (0.5, 0.1), "b": (1.0, 0.05), "c": (0.2, None)}
    rows = [("p", s, w, sd) for s, (w, sd) in held.items()]
    cases = [("a", 0.9, 0.02, 1e5, 1e5), ("d", 0.9, 0.02, 1e5, 1.1e5), ("d", 0.7, 0.5, 1e5, 1e5), ("d", 0.51, 0.02, 1e5, 1e5), ("d", 0.9, 0.02, 8e4, 1e5), ("d", 0.52, 3.0, 1e5, 1e5), ("d", 0.9, 0.02, 1e7, 1e7)]
    held = {s: (w, 0.02 if sd is None else sd) for s, (w, sd) in held.items()}
    df = spark.createDataFrame([(k, "p", s, *map(float, c)) for k, (s, *c) in enumerate(cases)] + [(99, "empty", "a", 0.9, 0.02, 1e5, 1e5)], "row_id int, portfolio string, symbol string, p double, sigma double, capital double, peak double")
    got = {r.row_id: r for r in portfolio.position_sizes(df, spark.createDataFrame(rows, "portfolio string, symbol string, fraction double, sigma double")).collect()}
    for k, (s, *c) in enumerate(cases):
        assert got[k].size == pytest.approx(plain_size(*c, s, held), rel=1e-5), k
    assert got[99].size == pytest.approx(plain_size(0.9, 0.02, 1e5, 1e5, "a", {}), rel=1e-5)


def test_stress_report(spark):
    rng = np.random.default_rng(6)
    pnl = {"a": rng.normal(size=80) * 0.1, "b": rng.normal(size=50) * 0.2}
    rows = [("p", s, float(v), k) for s, vs in pnl.items() for k, v in enumerate(vs)] + [("p", "a", None, 999), ("p", "a", float("nan"), 998), ("q", "x", 0.1, 1)]
    positions = spark.createDataFrame([("p", "a", 20_000.0, 0.1, 1e5), ("p", "b", 10_000.0, None, 1e5), ("q", "x", 5_000.0, 0.1, 1e5), ("none", "y", 0.0, 0.1, 1e5)], "portfolio string, symbol string, value double, sigma double, capital double")
    got = {r.portfolio: r for r in portfolio.stress_report(positions, spark.createDataFrame(rows, "portfolio string, symbol string, pnl double, d int"), ["d"]).collect()}
    joint = np.sort(pnl["a"][-50:] * 0.2 + pnl["b"] * 0.1)[:2]
    assert got["p"].cvar_historical == pytest.approx(-joint.mean()) and got["p"].cvar_stress == pytest.approx(portfolio.TAIL_LOSS * (0.2 * 0.1 + 0.1 * 0.02)) and got["p"].exposure_pct == pytest.approx(30)
    assert got["q"].cvar_historical == got["q"].cvar_stress and got["none"].cvar_stress == 0 and got["none"].cvar_ok


def test_honest_sharpe(spark):
    rng = np.random.default_rng(7)
    data = {"weak": rng.normal(0.001, 0.02, 200), "strong": rng.normal(0.02, 0.02, 400), "few": np.array([0.1] * 3), "short": np.array([0.01, 0.02, -0.01, 0.03, 0.0, 0.01])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "g string, ret double")
    got = {r.g: r for r in portfolio.honest_sharpe(df, ["g"]).collect()}

    def chance(s, n, skew, kurt, trials):
        norm, gamma = NormalDist(), 0.5772156649015329
        best = (1 - gamma) * norm.inv_cdf(1 - 1 / trials) + gamma * norm.inv_cdf(1 - 1 / (trials * math.e))
        return norm.cdf((s - best) / math.sqrt(max((1 - skew * s + (kurt - 1) / 4 * s * s) / (n - 1), 1e-12)))

    for k, x in data.items():
        s = x.mean() / (x.std() + 1e-10) * math.sqrt(50.4) if len(x) >= 5 else 0.0
        z = (x - x.mean()) / max(x.std(), 1e-12)
        skew, kurt = ((z**3).mean(), (z**4).mean()) if len(x) > 10 else (-0.3, 5.0)
        n = max(len(x), 100)
        want = chance(s, n, skew, kurt, 5000)
        assert got[k].sharpe == pytest.approx(s) and got[k].honest == pytest.approx(want, abs=1e-6) and got[k].surface == pytest.approx(chance(s, n, skew, kurt, 500), abs=1e-6)
        need = next((round(v, 2) for v in np.linspace(0.5, 5, 1000) if chance(v, n, skew, kurt, 5000) > 0.95), None)
        assert got[k].passed == (want > 0.95) and got[k].needed == (None if want > 0.95 else pytest.approx(need, abs=0.011))
    assert got["strong"].passed and not got["weak"].passed


# selection


def test_strengths_and_choice(spark):
    """Spearman against plain ranks, mutual information against plain counts; odd rows count where both values are there."""
    from tidemark.operators import selection

    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 200)
    a = y + rng.integers(0, 3, 200).astype(float)
    b = rng.integers(0, 4, 200).astype(float)
    rows = [(float(a[k]), None if k < 40 else float(b[k]), 1.0, float(k) if k < 20 else None, int(y[k])) for k in range(200)] + [(float("nan"), float("inf"), 1.0, 1.0, 1), (1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, few double, y int")
    got = {r.feature: r for r in selection.rank_correlation(df, ["a", "b", "flat", "few"], "y").collect()}

    def plain(x, z):
        rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        return abs(np.corrcoef(rank(x), rank(z))[0, 1])

    assert got["a"].strength == pytest.approx(plain(a, y)) and got["b"].strength == pytest.approx(plain(b[40:], y[40:])) and got["b"].n == 160
    assert got["flat"].strength is None and got["few"].strength is None
    information = {r.feature: r.strength for r in selection.shared_information(df.limit(200), ["a"], "y", 4).collect()}
    edges = np.quantile(a, [0.25, 0.5, 0.75])
    bins = np.array([(edges <= v).sum() for v in a])
    want = sum(p * math.log2(p / ((bins == i).mean() * (y == j).mean())) for i in set(bins) for j in (0, 1) if (p := ((bins == i) & (y == j)).mean()) > 0)
    assert information["a"] == pytest.approx(want)
    clusters = spark.createDataFrame([("a", "1"), ("b", "1"), ("flat", "2"), ("few", "3")], "feature string, cluster string")
    chosen = lambda *always: [r.feature for r in selection.best_per_cluster(selection.rank_correlation(df, ["a", "b", "flat", "few"], "y"), clusters, always).orderBy("place").collect()]
    assert sorted(chosen()) == ["a", "b", "few", "flat"]  # one alone would be too few
    assert chosen("few") == ["few", "a"] and chosen("a") == ["a", "b"]


def test_weights_summary(spark):
    from tidemark.operators import windows

    row = spark.range(1).select(windows.weights_summary(F.lit(0.4), 1e-4).alias("s"), windows.window_weights(F.lit(0.4), 5).alias("w"), windows.window_weights(F.lit(0.4), 1).alias("one")).first()
    want = windows.fracdiff_weights(0.4, 1e-4)
    assert row.s.n == len(want) and row.s.total == pytest.approx(np.abs(want).sum()) and row.s.lowest == pytest.approx(abs(want[-1])) and row.s.highest == 1
    assert row.w == pytest.approx(want[:5]) and row.one == [1.0]


def test_payload_problems(spark):
    from tidemark.streaming import bridge

    day = datetime.date(2024, 1, 1)
    heads = [("ok", 1, None), ("empty", 1, day), ("twice", 1, day), ("negative", 1, day), ("null", 1, day), ("gross", 1, day), ("old", 1, day - datetime.timedelta(1)), ("zero", 0, day), ("none", None, day)]
    lines = [("ok", "A", 0.5), ("ok", "B", 0.5), ("twice", "A", 0.1), ("twice", "A", 0.1), ("negative", "A", -0.1), ("null", "A", None), ("gross", "A", 0.7), ("gross", "B", 0.4), ("old", "A", 0.1), ("zero", "A", 0.1), ("none", "A", 0.1), ("other", "A", 0.1)]
    got = bridge.payload_problems(spark.createDataFrame(heads, "k string, revision int, valid_until date"), spark.createDataFrame(lines, "k string, instrument string, weight double"), "k", F.lit(day))
    assert {r.k: r.problem for r in got.collect()} == {"ok": None, "empty": "empty", "twice": "duplicate_instrument", "negative": "negative_weight", "null": "negative_weight", "gross": "gross", "old": "expired", "zero": "revision", "none": "revision"}


def test_alike_rows_are_counted_once(spark):
    """Fits see a row for all that agree, areas and predictions are those of all rows."""
    rows = spark.range(600).select(F.col("id").alias("pos"), F.array((F.col("id") % 5).cast("double")).alias("features"), (F.col("id") * 7 % 3 == 0).cast("double").alias("y"))
    seen = []

    def fit(train):
        seen.append((train.count(), train.agg(F.sum("_n")).first()[0]))
        return F.get("features", F.lit(0)) / 10

    def plain(train):
        return lambda df: df.withColumn("p", F.get("features", F.lit(0)) / 10).drop("features")

    every = crossval.cross_predictions(rows, plain)
    whole = crossval.cross_predictions(rows, fit, alike=("features", "y"))
    counted = crossval.cross_predictions(rows, fit, alike=("features", "y"), whole=False)
    key = lambda df: sorted((r.path, r.pos, r.y, r.n_train, r.p) for r in df.collect())
    assert key(whole) == key(every) and counted.count() < every.count() / 3
    assert sorted(map(tuple, crossval.verdict(counted, count="_n").collect()), key=str) == sorted(map(tuple, crossval.verdict(every).collect()), key=str)
    trained = {r.n_train for r in every.select("n_train").distinct().collect()}
    assert {n for _, n in seen} == trained and all(n < 300 for n, _ in seen)


def test_calibration_of_counted_rows(spark):
    """Rows counted by features, label and cluster, with the sums of their weights, calibrate as all of them do."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int"))
    names = F.when(F.col("id") % 30 == 0, "small").when(F.col("id") % 2 == 0, "a").otherwise("b")
    rows = spark.range(2400).select(
        F.col("id").alias("pos"), F.array((F.col("id") * 7 % 5).cast("double")).alias("features"), (F.col("id") * 11 % 13 < F.col("id") * 7 % 5 + 4).cast("double").alias("y"), names.alias("cluster"), day.alias("date")
    )
    fit = lambda train: F.get("features", F.lit(0)) / 10
    rows = portfolio.weighted(rows, "date", "_weight")
    every = crossval.cross_predictions(rows, fit, alike=("features", "y"))
    counted = crossval.cross_predictions(rows, fit, alike=("features", "y"), whole=False, by=("cluster",), weight="_weight")
    assert counted.count() < every.count() / 3
    _, want = portfolio.cluster_calibrated(every, "pos", "cluster", "p", "y", "date", learning.isotonic, least=500)
    _, got = portfolio.cluster_calibrated(counted, "pos", "cluster", "p", "y", "_weight", learning.isotonic, least=500, count="_n")
    got, want = ({r.cluster: r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() == {"a", "b", "small"} and got["small"].mode == "global" and got["a"].mode == "own"
    for k, r in want.items():
        assert got[k].n == r.n and got[k].gap_before == pytest.approx(r.gap_before, abs=1e-12) and got[k].gap_after == pytest.approx(r.gap_after, abs=1e-9)
