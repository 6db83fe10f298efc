"""Clusters, drift and importance against plain forms and planted cases."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import clusters, drift, importance, trees


def plain_ward(x):
    """Merges by the growth of the sum of squares, worked out from the members of every two clusters."""
    groups, merges = {k: [k] for k in range(len(x))}, []

    def height(a, b):
        a, b = x[groups[a]], x[groups[b]]
        return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum())

    while len(groups) > 1:
        h, i, j = min((height(i, j), i, j) for i in groups for j in groups if i < j)
        merges.append((i, j, h))
        groups[i] += groups.pop(j)
    return merges


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_ward(n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    got = clusters.ward(np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)))
    want = plain_ward(x)
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    assert len(set(clusters.cut(n, got, most=3).tolist())) == min(n, 3)
    assert len(set(clusters.cut(n, got, height=0.0).tolist())) == n


def test_ward_clusters(spark):
    """Two groups of items, each linked by its own distances; pairs that are missing are 1 apart."""
    near = [("g", "a", "b", 0.05), ("g", "a", "c", 0.9), ("g", "b", "c", 0.95), ("g", "c", "d", 0.1), ("h", "a", "b", 0.8), ("h", "b", "c", None), ("i", "x", "x", 0.0)]
    got = clusters.ward_clusters(spark.createDataFrame(near, "k string, a string, b string, vi double"), ["k"], 0.3).collect()
    assert {(r.k, r.feature): (r.cluster, r.size) for r in got} == {("g", "a"): (1, 2), ("g", "b"): (1, 2), ("g", "c"): (2, 2), ("g", "d"): (2, 2), ("h", "a"): (1, 1), ("h", "b"): (2, 1), ("h", "c"): (3, 1), ("i", "x"): (1, 1)}
    assert {r.feature: r.inside for r in got if r.k == "g"} == pytest.approx({"a": 0.05, "b": 0.05, "c": 0.1, "d": 0.1})


def marks(spark, centres, per):
    rng = np.random.default_rng(5)
    rows = [(f"s{g}{k}", *map(float, c + 0.1 * rng.normal(size=2)), None if k else 1.0) for g, c in enumerate(centres) for k in range(per[g])]
    return spark.createDataFrame(rows, "symbol string, x double, y double, z double")


def test_symbol_clusters(spark):
    """Three far groups are three clusters; the lone symbol goes to the nearest; names follow the members."""
    df = marks(spark, [np.array(c) for c in ((0, 0), (9, 9), (0, 9), (8, 0))], [5, 5, 5, 1])
    got = {r.symbol: r.cluster for r in clusters.symbol_clusters(df, "symbol").collect()}
    assert len(got) == 16 and all(len({got[f"s{g}{k}"] for k in range(5)}) == 1 for g in range(3))
    assert [got["s00"], got["s10"], got["s20"]] == ["cluster_1", "cluster_2", "cluster_3"] and got["s30"] in ("cluster_1", "cluster_2")
    few = clusters.symbol_clusters(df.limit(6), "symbol").collect()
    assert {(r.cluster, r.method) for r in few} == {("cluster_1", "too_few_symbols")}
    assert clusters.symbol_clusters(df.limit(0), "symbol").count() == 0
    odd = df.withColumn("x", F.when(F.col("symbol") == "s01", float("nan")).when(F.col("symbol") == "s02", float("inf")).otherwise(F.col("x")))
    assert clusters.symbol_clusters(odd.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0)], df.schema)), "symbol").count() == 16


def test_signatures(spark):
    df = spark.createDataFrame([("a", float(k), None if k % 2 else 1.0) for k in range(9)], "symbol string, v double, w double")
    assert clusters.signatures(df, "symbol", ["v", "w"]).first().asDict() == pytest.approx({"symbol": "a", "v_median": 4.0, "v_iqr": 4.0, "v_coverage": 1.0, "w_median": 1.0, "w_iqr": 0.0, "w_coverage": 5 / 9})


# drift


def days(symbol, x, start=0):
    return [(symbol, start + k, *map(float, row)) for k, row in enumerate(x)]


def test_area():
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 5, 60).astype(float), rng.integers(0, 2, 60)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert trees.area(s, y) == pytest.approx(np.mean(pairs)) and trees.area(s, np.ones(60)) == 0.5


def test_spans_and_blocks(spark):
    """The newest rows are marked, gaps filled; replicates are whole blocks of neighbours that belong to the symbol."""
    rows = [("a", k, float(k) if k % 7 else None) for k in range(50)] + [("b", k, 1000.0 + k) for k in range(40)] + [("few", k, 1.0) for k in range(10)] + [(None, 1, 1.0), ("a", None, 5.0)]
    df = spark.createDataFrame(rows, "s string, d int, v double")
    got = drift.spans(df, "s", "d", ["v"], 30, 5).collect()
    assert {r.s for r in got} == {"a", "b"} and all(sorted(r.pos for r in got if r.s == s) == list(range(35)) for s in "ab")
    by = {(r.s, r.pos): (r.x[0], r.y) for r in got}
    assert by["b", 34] == (1039.0, 1) and by["b", 29] == (1034.0, 0) and by["a", 34] == (48.0, 1) and by["a", 6] == (20.0, 0)
    reps = drift.block_replicates(drift.spans(df, "s", "d", ["v"], 30, 5), "s", 35, 20, 4).collect()
    sets = {}
    for r in reps:
        sets.setdefault((r.s, r.replicate), {})[r.pos] = (r.block, r.x[0])
    assert len(sets) == 40 and all(sorted(rows) == list(range(35)) for rows in sets.values())
    for rows in sets.values():
        for k in range(34):
            if rows[k][0] == rows[k + 1][0] and rows[k][1] >= 1000:
                assert rows[k + 1][1] == rows[k][1] + 1
    assert len({tuple(v[1] for _, v in sorted(rows.items())) for rows in sets.values()}) == 40


def test_drift_of_equal_and_shifted_series(spark):
    """Equal series aren't reported, shifted and spread ones are; few rows can't be tested."""
    rng, rows = np.random.default_rng(8), []
    for k in range(6):
        rows += days(f"same{k}", rng.normal(size=(300, 3)))
    moved, wide = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    moved[-30:, 1] += 1.5
    wide[-30:] *= 4
    rows += days("moved", moved) + days("wide", wide) + days("few", rng.normal(size=(20, 3)))
    df = spark.createDataFrame(rows, "symbol string, d int, a double, b double, c double")
    tests = drift.drift_test(df, "symbol", "d", ["a", "b", "c"], replicates=60, trees=30)
    got = {r.symbol: r for r in tests.collect()}
    assert got["moved"].p_value < 0.05 and got["wide"].p_value < 0.05 and got["moved"].severity == got["wide"].severity == "SEVERE"
    same = [got[f"same{k}"] for k in range(6)]
    assert np.mean([r.p_value for r in same]) > 0.2 and sum(r.drifted for r in same) <= 1
    assert got["few"].asDict() == {"symbol": "few", "n_ref": 0, "n_recent": 0, "auc": 0.5, "p_value": 1.0, "drifted": False, "severity": "NONE"}
    best = drift.feature_drift(df, "symbol", "d", ["a", "b", "c"], trees=30).where("place = 1 and symbol = 'moved'").first()
    assert best.feature == "b" and best.auc > 0.65
    port = drift.portfolio_drift(tests, 2).first()
    assert (port.n_assets, port.alert, port.action) == (9, True, "halt")
    assert drift.drift_test(df.limit(0), "symbol", "d", ["a"], replicates=3).count() == 0


# importance


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permuted(spark, n):
    rows = spark.range(n).select("id", *[importance.permuted(F.col("id"), n, F.lit(7), F.lit(k)).alias(f"p{k}") for k in range(3)]).toPandas()
    for k in range(3):
        assert sorted(rows[f"p{k}"]) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(rows.id, rows.p0)[0, 1]) < 0.1 and (rows.p0 != rows.p1).mean() > 0.9


def test_places_in_batches_are_those_of_the_expression(spark):
    for n in (1, 7, 1000):
        want = [r.p for r in spark.range(n).coalesce(1).select(importance.permuted(F.col("id"), n, F.lit(43), F.lit(2), F.lit(4)).alias("p")).collect()]
        assert importance.permuted_places(np.arange(n), n, 43, 2, 4).tolist() == want


def test_permuted_rows_are_scored_once_a_cell(spark):
    """Losses are those of a forest that scores every permuted row; it is asked for a row per distinct cells alone."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 5, 2000) / 4, rng.normal(size=2000), np.ones(2000)])
    y = (x[:, 0] + x[:, 1] > 0.5).astype(float)
    df = spark.createDataFrame([(k, *map(float, x[k]), float(y[k])) for k in range(2000)], "pos long, a double, b double, c double, y double")
    columns, groups, asked = ["a", "b", "c"], {3: ["a", "c"], 5: ["b"]}, []
    model = importance._fit(df, columns, "y", 5, 4, 1)

    class Counting:
        toDebugString = model.toDebugString

        def transform(self, rows):
            asked.append(rows.count())
            return model.transform(rows)

    got = {(r.grp, r.repeat): r.loss for r in importance.permutation_losses(Counting(), df, columns, "y", groups, 2, 9).collect()}
    cells = importance.Cells(model, columns)
    assert sum(asked) <= np.prod([len(c) + 1 for c in cells.cuts]) < 2000

    def area(rows):
        p = [float(r.probability[1]) for r in model.transform(VectorAssembler(inputCols=columns, outputCol="_features").transform(spark.createDataFrame(rows.tolist(), columns)).coalesce(1)).collect()]
        p, won = np.array(p), y == 1
        return ((p[won][:, None] > p[~won]).mean() + (p[won][:, None] == p[~won]).mean() / 2).item()

    for (g, r), loss in got.items():
        other, own = x.copy(), [columns.index(c) for c in groups[g]]
        other[:, own] = x[importance.permuted_places(np.arange(2000), 2000, 9, g, r)][:, own]
        assert loss == pytest.approx(area(x) - area(other), abs=1e-12)
    assert sorted(got) == [(3, 0), (3, 1), (5, 0), (5, 1)]


def test_cells_of_many_features_take_several_words(spark):
    """Scores of cells are those of the rows, where they need more than a word."""
    x = np.random.default_rng(3).normal(size=(600, 40))
    names = [f"x{k}" for k in range(40)]
    df = spark.createDataFrame([(*map(float, v), float(v.sum() > 0)) for v in x], [*names, "y"])
    model = importance._fit(df, names, "y", 20, 6, 1)
    cells = importance.Cells(model, names)
    assert len(cells.words) > 1
    packed = df.select("*", *cells.pack())
    want = model.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(packed)).select(*cells.words, vector_to_array("probability")[1].alias("p"))
    rows = want.join(cells.score(packed.select(*cells.words).distinct()), cells.words).collect()
    assert len(rows) == 600 and all(r.p == r._p for r in rows)


def test_only_the_planted_cluster_matters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    x[:, 1] = x[:, 0] + 0.3 * rng.normal(size=3000)
    y = (x[:, 0] + 0.3 * rng.normal(size=3000) > 0).astype(int)
    rows = [(k, *map(float, x[k]), int(y[k])) for k in range(3000)] + [(9000, None, 0.0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y int")
    got = {r.feature: r for r in importance.clustered_importance(df.where("id % 3 > 0"), df.where("id % 3 = 0"), "id", {1: ["a", "b"], 2: ["c"], 3: ["d"]}, "y", 4, 3, 10).collect()}
    assert got["a"].auc_base > 0.9 and got["a"].loss_mean > 0.3 and got["a"].status == "FAIL"
    assert abs(got["c"].loss_mean) < 0.02 and abs(got["d"].loss_mean) < 0.02
    assert got["a"].share > got["b"].share and got["a"].share + got["b"].share == pytest.approx(1) and got["c"].share == 1
    assert got["a"].importance == pytest.approx(got["a"].loss_mean * got["a"].share)
