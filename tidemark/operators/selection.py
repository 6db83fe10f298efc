"""One feature of each cluster: the one that says most about a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.information import quantile_bins
from tidemark.operators.prefix import prefix_sum

#: Fewest rows with both values, and least deviation, of a feature that can be chosen.
ROWS, SPREAD = 30, 1e-8


def _long(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y) of rows that have both, non-finite values being none."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    rows = df.select(finite(target).alias("y"), *[finite(c).alias(c) for c in features])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features]))
    return rows.select("y", each.alias("e")).select("e.feature", "e.x", "y").where("x is not null and y is not null")


def _average_rank(values: DataFrame, column: str, out: str) -> DataFrame:
    """(feature, column, out): the average rank of each distinct value of a feature, from counts."""
    counts = values.groupBy("feature", column).agg(F.count("*").alias("_n"))
    ranked = prefix_sum(counts, ["feature"], [F.col(column)], "_n", "_below")
    return ranked.select("feature", column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))


def rank_correlation(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n, strength): the absolute Spearman correlation of each feature with the target, over rows that have both.

    Features with fewer than 30 such rows, or next to no spread, have none; a correlation that is undefined is 0.
    """
    rows = _long(df, features, target)
    both = rows.join(_average_rank(rows, "x", "rx"), ["feature", "x"]).join(_average_rank(rows, "y", "ry"), ["feature", "y"])
    one = both.groupBy("feature").agg(F.count("*").alias("n"), F.abs(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("strength"), F.stddev("x").alias("_s"))
    fit = (F.col("n") >= ROWS) & (F.col("_s") >= SPREAD)
    return one.select("feature", "n", F.when(fit, F.when(F.isnan("strength"), 0.0).otherwise(F.coalesce("strength", F.lit(0.0)))).alias("strength"))


def shared_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, n, strength): mutual information in bits of each feature, in bins by quantiles, with the target's values."""
    binned = quantile_bins(df.where(F.col(target).isNotNull()), features, bins)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bin").alias("b")) for c in features]))
    cells = binned.select(F.col(target).alias("y"), each.alias("e")).select("y", "e.feature", "e.b").where("b is not null").groupBy("feature", "b", "y").agg(F.count("*").alias("c"))
    over = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))  # a row per cell
    p = cells.select("feature", "c", over().alias("n"), over("b").alias("nb"), over("y").alias("ny"))
    bits = F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("nb") * F.col("ny"))))
    return p.groupBy("feature").agg(F.first("n").alias("n"), F.greatest(bits, F.lit(0.0)).alias("strength"))


def best_per_cluster(strengths: DataFrame, clusters: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """(feature, cluster, strength, place) of the chosen: those of ``always``, and of each cluster (feature, cluster) the strongest other.

    Of equals the first by name is chosen; clusters whose features have no strength, and ``always`` among themselves, give
    none of their own. With fewer than two chosen in all, every feature is. ``clusters`` names each feature once and is
    bounded by the number of features.
    """
    rows = strengths.join(clusters, "feature", "left").withColumn("_kept", F.col("feature").isin(*always) if always else F.lit(False))
    best: Column = F.row_number().over(Window.partitionBy("cluster", "_kept").orderBy(F.desc_nulls_last("strength"), "feature"))
    rows = rows.withColumn("_chosen", F.col("_kept") | ((best == 1) & F.col("strength").isNotNull() & F.col("cluster").isNotNull()))
    enough = F.count_if("_chosen").over(Window.partitionBy(F.lit(0))) >= 2  # a row per feature
    rows = rows.withColumn("_all", ~enough).where("_chosen or _all")
    return rows.select("feature", "cluster", "strength", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_kept"), F.desc_nulls_last("strength"), "feature")).alias("place"))
