"""Two-sample drift test by a classifier, with a block bootstrap.

For each symbol the newest days are told from the days before them. The chance that a classifier does as well when
nothing has changed comes from replicates in which whole blocks of days are drawn again from both spans, so that what
neighbouring days share is kept. Blocks are rows tagged (symbol, replicate, block): draws are a join, and each replicate
is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.trees import out_of_fold_area
from tidemark.sources.folders import checkpointed

#: Days before and days tested, days of a block, limits of the area and of the chance.
BEFORE, RECENT, BLOCK = 252, 30, 5
MODERATE, SEVERE, CHANCE = 0.55, 0.65, 0.05


def spans(df: DataFrame, symbol: str, day: str, features: list[str], before: int = BEFORE, recent: int = RECENT) -> DataFrame:
    """(symbol, pos, y, x): the newest ``before + recent`` rows of symbols that have as many, with the newest marked.

    A missing value is the last one before it, else the first after it, else 0; non-finite values are missing. Days with
    several rows are ordered by their values. What is sorted is a symbol's history.
    """
    order = [F.col(day), *[F.col(c) for c in features]]
    past = Window.partitionBy(symbol).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(symbol).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = df.where(F.col(symbol).isNotNull() & F.col(day).isNotNull()).select(symbol, day, *[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double")).alias(c) for c in features])
    filled = [F.coalesce(F.last(c, True).over(past), F.first(c, True).over(ahead), F.lit(0.0)) for c in features]
    last = F.row_number().over(Window.partitionBy(symbol).orderBy(*[c.desc() for c in order]))
    n = F.count("*").over(Window.partitionBy(symbol))
    rows = rows.select(symbol, F.array(*filled).alias("x"), last.alias("_last"), n.alias("_n"))
    rows = rows.where((F.col("_n") >= before + recent) & (F.col("_last") <= before + recent))
    return rows.select(symbol, (before + recent - F.col("_last")).alias("pos"), (F.col("_last") <= recent).cast("int").alias("y"), "x")


def block_replicates(rows: DataFrame, symbol: str, n: int, replicates: int, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(symbol, replicate, block, pos, x): rows of ``replicates`` draws of whole blocks, with replacement, from the ``n`` of each symbol.

    A block starts anywhere that leaves room for it, by the hash of (symbol, replicate, block); the last is cut to n rows.
    """
    size = min(block, n)
    drawn = rows.select(symbol).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // size) - 1))))
    drawn = drawn.withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), symbol, "replicate", "block"), F.lit(n - size + 1)))
    drawn = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    drawn = drawn.select(F.col(symbol), "replicate", "block", (F.col("block") * size + F.col("_k")).alias("_pos"), (F.col("_at") + F.col("_k")).alias("pos")).where(F.col("_pos") < n)
    return drawn.join(rows.select(symbol, "pos", "x"), [symbol, "pos"]).select(symbol, "replicate", "block", F.col("_pos").alias("pos"), "x")


def _areas(keys: list[str], folds: int, seed: int, trees: int):
    """Out-of-fold area of each group of rows (keys, pos, y, x)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        rng = np.random.default_rng([seed, int(frame["replicate"].iloc[0]) if "replicate" in frame else 0])
        x = np.array(frame["x"].tolist(), dtype=float).reshape(len(frame), -1)
        value = out_of_fold_area(x, frame["y"].to_numpy(), rng, folds, trees=trees)
        return pd.DataFrame([[*frame[keys].iloc[0], value]], columns=[*keys, "auc"])

    return run


def drift_test(df: DataFrame, symbol: str, day: str, features: list[str], before: int = BEFORE, recent: int = RECENT, replicates: int = 500, folds: int = 5, seed: int = 42, trees: int = 60) -> DataFrame:
    """(symbol, n_ref, n_recent, auc, p_value, drifted, severity) for every symbol of ``df``.

    ``p_value`` is the share of replicates whose area is at least the observed; both are scored alike. Severity is NONE
    unless the area is above 0.55 and the chance below 0.05, then MODERATE below an area of 0.65, else SEVERE. Symbols
    with too few rows have area 0.5, chance 1 and no rows; null symbols and days are left out.
    """
    rows = checkpointed(spans(df, symbol, day, features, before, recent))
    n, kind = before + recent, dict(df.dtypes)[symbol]
    newest = F.col("pos") >= before
    real = rows.select(symbol, F.lit(0).alias("replicate"), "pos", "x")
    null = block_replicates(rows, symbol, n, replicates, seed=seed).select(symbol, "replicate", "pos", "x")
    scored = real.union(null).withColumn("y", newest.cast("int")).groupBy(symbol, "replicate").applyInPandas(_areas([symbol, "replicate"], folds, seed, trees), f"{symbol} {kind}, replicate int, auc double")
    scored = checkpointed(scored)
    seen = scored.where("replicate = 0").select(F.col(symbol).alias("_s"), F.col("auc").alias("_seen"))
    chance = scored.where("replicate > 0").join(seen, F.col(symbol) == F.col("_s")).groupBy(symbol).agg(F.first("_seen").alias("auc"), F.avg((F.col("auc") >= F.col("_seen")).cast("int")).alias("p_value"))
    drifted = (F.col("auc") > MODERATE) & (F.col("p_value") < CHANCE)
    every = df.where(F.col(symbol).isNotNull()).select(symbol).distinct().join(chance, symbol, "left")
    tested = F.col("auc").isNotNull()
    return every.select(
        symbol, F.when(tested, before).otherwise(0).alias("n_ref"), F.when(tested, recent).otherwise(0).alias("n_recent"), F.coalesce("auc", F.lit(0.5)).alias("auc"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
        F.coalesce(drifted, F.lit(False)).alias("drifted"), F.when(drifted & (F.col("auc") < SEVERE), "MODERATE").when(drifted, "SEVERE").otherwise("NONE").alias("severity"),
    )


def feature_drift(df: DataFrame, symbol: str, day: str, features: list[str], before: int = BEFORE, recent: int = RECENT, folds: int = 3, seed: int = 42, trees: int = 60) -> DataFrame:
    """(symbol, feature, auc, place): how well each feature alone tells the newest days, best first."""
    rows, kind = spans(df, symbol, day, features, before, recent), dict(df.dtypes)[symbol]
    each = rows.select(symbol, "pos", "y", F.posexplode("x").alias("_k", "_v")).select(symbol, F.get(F.array(*[F.lit(c) for c in features]), "_k").alias("feature"), "pos", "y", F.array("_v").alias("x"))
    scored = each.groupBy(symbol, "feature").applyInPandas(_areas([symbol, "feature"], folds, seed, trees), f"{symbol} {kind}, feature string, auc double")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(symbol).orderBy(F.desc("auc"), "feature")))  # a row per feature


def portfolio_drift(tests: DataFrame, least: int = 3) -> DataFrame:
    """One row over the symbols of ``drift_test``: counts by severity, and an alert if ``least`` are SEVERE."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("SEVERE", "MODERATE", "NONE")]
    alert = F.col("n_severe") >= least
    return tests.agg(F.count("*").alias("n_assets"), *counts).withColumn("alert", alert).withColumn("action", F.when(alert, "halt").otherwise("go_on"))
