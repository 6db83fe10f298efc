"""Entropy, shared information and rank statistics by contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import prefix_sum


def quantile_bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Adds ``<column>_bin``: the number of inner quantile edges that the value is at or above."""
    inner = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    edges = df.agg(*[F.percentile(c, inner).alias(f"_e_{c}") for c in columns])
    out = df.join(F.broadcast(edges))  # one row of edges

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.size(F.filter(f"_e_{c}", lambda e: e <= F.col(c)))).alias(f"{c}_bin")

    return out.select(*df.columns, *[at(c) for c in columns])


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Joint entropy of the columns in bits."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row per cell
    return counts.select(share.alias("p")).agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("bits"))


def vi_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, vi): normalised variation of information of every pair of binned columns, from one pass of counts."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs]))
    joint = df.select(cells.alias("c")).groupBy("c.a", "c.b", "c.x", "c.y").agg(F.count("*").alias("n"))
    pair = Window.partitionBy("a", "b")
    p = joint.withColumn("p", F.col("n") / F.sum("n").over(pair))
    p = p.withColumn("px", F.sum("p").over(Window.partitionBy("a", "b", "x"))).withColumn("py", F.sum("p").over(Window.partitionBy("a", "b", "y")))
    h = p.groupBy("a", "b").agg((-F.sum(F.col("p") * F.log2("p"))).alias("hxy"), F.sum(F.col("p") * F.log2(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))
    return h.select("a", "b", F.coalesce(F.try_divide(F.col("hxy") - F.col("mi"), F.col("hxy")), F.lit(1.0)).alias("vi"))  # columns of one value are furthest apart


def auc(df: DataFrame, score: str, positive: Column, keys: list[str], count: str | None = None) -> DataFrame:
    """Area under the curve per group, from average ranks of the distinct scores; null for a group of one class.

    A row counts as the number in column ``count``, if named.
    """
    times = F.col(count) if count else F.lit(1).cast("long")
    values = df.groupBy(*keys, score).agg(F.sum(times).alias("n"), F.sum(F.when(positive, times).otherwise(0)).alias("pos"))
    ranked = prefix_sum(values, keys, [F.col(score)], "n", "_below").withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2, p * (n - p)).alias("auc"))
