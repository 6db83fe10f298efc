"""Combinatorial purged cross-validation: every pair of folds is tested by a model that saw nothing near it.

Rows have a position; a path is a set of folds, and what it may train on is a few ranges of positions. Models are fit by
pyspark.ml on those ranges; what comes out is a row per path and tested row, and areas, calibration and the verdict are
aggregates over it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.information import auc
from tidemark.sources.folders import checkpointed

#: Fewest rows to train on and to test, share of areas under a half, and of areas under 0.52, that pass.
TRAIN, TEST, OVERFIT, LOW_AREA, LOW_SHARE = 40, 15, 0.10, 0.52, 0.30


def bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """Positions [lo, hi) of the folds: as even as can be, the first ones larger."""
    size, rest = divmod(n, folds)
    at = [k * size + min(k, rest) for k in range(folds + 1)]
    return list(zip(at, at[1:]))


def purged(n: int, folds: int, path: tuple[int, ...], embargo: int, span: bool) -> list[tuple[int, int]]:
    """Positions [lo, hi) that a path doesn't train on: its folds and ``embargo`` rows on either side of each.

    With ``span`` it is all between the first and the last of its folds too.
    """
    own = [bounds(n, folds)[k] for k in sorted(path)]
    if span:
        own = [(own[0][0], own[-1][1])]
    out: list[tuple[int, int]] = []
    for lo, hi in ((max(0, lo - embargo), min(n, hi + embargo)) for lo, hi in own if hi > lo):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _within(pos: Column, ranges: list[tuple[int, int]]) -> Column:
    inside = F.lit(False)
    for lo, hi in ranges:
        inside = inside | ((pos >= lo) & (pos < hi))
    return inside


def paths(n: int, folds: int, tests: int, embargo: float, span: bool) -> dict[str, tuple[list, list, int]]:
    """Of each path that has enough rows: positions not trained on, those tested, and how many are left to train on."""
    out, gap = {}, max(1, int(n * embargo))
    for path in combinations(range(folds), tests):
        gone, held = purged(n, folds, path, gap, span), [bounds(n, folds)[k] for k in path]
        train, test = n - sum(hi - lo for lo, hi in gone), sum(hi - lo for lo, hi in held)
        if train >= TRAIN and test >= TEST:
            out["-".join(map(str, path))] = (gone, held, train)
    return out


def path_roles(rows: DataFrame, n: int, folds: int = 6, tests: int = 2, embargo: float = 0.01, span: bool = False) -> DataFrame:
    """``rows`` (pos, ...) once for each path that trains on or tests them: adds path and role (train, test)."""
    tags = []
    for name, (gone, held, _) in paths(n, folds, tests, embargo, span).items():
        role = F.when(_within(F.col("pos"), held), "test").when(~_within(F.col("pos"), gone), "train")
        tags.append(F.struct(F.lit(name).alias("path"), role.alias("role")))
    if not tags:
        return rows.limit(0).withColumns({"path": F.lit(""), "role": F.lit("")})
    return rows.select("*", F.inline(F.array(*tags))).where("role is not null")


def _counted(rows: DataFrame, own: list[str], cuts: list[int], weight: str | None) -> DataFrame:
    """A row for all ``rows`` that agree in columns ``own`` and lie between the same ``cuts``: their number ``_n``, the first ``pos``, the sum of ``weight``."""
    stretch = sum(((F.col("pos") >= c).cast("int") for c in cuts), F.lit(0))
    sums = [F.sum(weight).alias(weight)] if weight else []
    return rows.groupBy(*own, stretch.alias("_stretch")).agg(F.count("*").alias("_n"), F.min("pos").alias("pos"), *sums).drop("_stretch")


def cross_predictions(
    rows: DataFrame, fit: Callable, folds: int = 6, tests: int = 2, embargo: float = 0.01, span: bool = False,
    alike: tuple[str, str] | None = None, whole: bool = True, by: tuple[str, ...] = (), weight: str | None = None,
) -> DataFrame | None:
    """``rows`` (pos from 0, ...) of each path's test with ``path``, ``n_train`` and the chance ``p`` of a model that ``fit`` makes of its training rows.

    ``fit`` takes training rows and returns a function that adds p. None if no path has enough rows. With ``alike``,
    columns of features and label, rows that agree in them are one row with its number in ``_n``, counted once for all
    paths between the places where a path's training or test begins or ends; ``fit`` takes those and returns p as a
    column of the features, which are left out of what comes out. That is all rows, read once, or, not ``whole``, the
    counted ones: those agree in columns ``by`` too, and hold the sum of column ``weight``.
    """
    rows = checkpointed(rows)  # read once per model
    n = rows.count()
    every, out = paths(n, folds, tests, embargo, span), None
    if alike:
        cuts = sorted({edge for gone, held, _ in every.values() for lo, hi in [*gone, *held] for edge in (lo, hi)})
        finer = None if whole or not (by or weight) else checkpointed(_counted(rows, [*alike, *by], cuts, weight))
        counted = checkpointed(_counted(rows, [*alike], cuts, None))
        tests_of = []
        for name, (gone, held, train) in every.items():
            chance = fit(counted.where(~_within(F.col("pos"), gone)))
            tests_of.append(F.when(_within(F.col("pos"), held), F.struct(F.lit(name).alias("path"), F.lit(train).alias("n_train"), chance.alias("p"))))
        if not tests_of:
            return None
        own = (rows if whole else counted if finer is None else finer).select("*", F.inline(F.filter(F.array(*tests_of), lambda t: t.isNotNull())))
        return checkpointed(own.drop(alike[0]))
    for name, (gone, held, train) in every.items():
        score = fit(rows.where(~_within(F.col("pos"), gone)))
        part = score(rows.where(_within(F.col("pos"), held))).withColumns({"path": F.lit(name), "n_train": F.lit(train)})
        out = part if out is None else out.unionByName(part)
    return None if out is None else checkpointed(out)


def verdict(predictions: DataFrame, p: str = "p", y: str = "y", count: str | None = None) -> DataFrame:
    """A row per path (n_train, n_test, auc, beats_chance) and one for all: mean and deviation of the areas, the share under a half and its verdict.

    A path whose test has one class has an area of 0.5. The whole passes if under a tenth of the areas are below 0.5 and
    three tenths at most below 0.52. A row counts as the number in column ``count``, if named.
    """
    sizes = predictions.groupBy("path").agg(F.first("n_train").cast("long").alias("n_train"), (F.sum(count) if count else F.count("*")).alias("n_test"))
    areas = auc(predictions, p, F.col(y) == 1, ["path"], count)
    each = sizes.join(areas, "path").select("path", "n_train", "n_test", F.coalesce("auc", F.lit(0.5)).alias("auc"))
    low = F.avg((F.col("auc") < 0.5).cast("double"))
    under = F.avg((F.col("auc") < LOW_AREA).cast("double"))
    whole = each.agg(F.count("*").alias("n_paths"), F.avg("auc").alias("auc"), F.stddev("auc").alias("auc_std"), low.alias("overfit"), under.alias("low"))
    whole = whole.where("n_paths > 0").select(
        F.lit("all").alias("path"), F.lit(None).cast("long").alias("n_train"), "n_paths", "auc", "auc_std", "overfit", F.col("low").alias("low_share"),
        F.when((F.col("overfit") < OVERFIT) & (F.col("low") <= LOW_SHARE), "PASS").otherwise("FAIL").alias("status"),
    )
    rows = each.select("path", "n_train", F.col("n_test").alias("n_paths"), "auc", F.lit(None).cast("double").alias("auc_std"), F.lit(None).cast("double").alias("overfit"), F.lit(None).cast("double").alias("low_share"), F.when(F.col("auc") > 0.5, "beats_chance").otherwise("no_better").alias("status"))
    return rows.union(whole).withColumnRenamed("n_paths", "n")
