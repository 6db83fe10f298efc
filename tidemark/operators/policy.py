"""Trading policies: gates, daily top-n, cooldown, cross-sectional contests, time folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import prefix_sum


def cooldown(df: DataFrame, key: str, day: str, order: str, days: int) -> DataFrame:
    """Rows left when each kept row shuts out those of its key within ``days`` days after it.

    Only the first row of a day, by ``order``, can stay; what is folded per key is its days, whose number is bounded.
    """
    at = F.datediff(day, F.lit("1970-01-01").cast("date"))
    first = df.groupBy(key, at.alias("_d")).agg(F.min(order).alias(order))
    begin = F.array().cast("array<int>")
    take = lambda kept, d: F.size(kept).eqNullSafe(0) | (d - F.try_element_at(kept, F.lit(-1)) > days)
    fold = F.aggregate(F.sort_array(F.collect_list("_d")), begin, lambda kept, d: F.when(take(kept, d), F.array_append(kept, d)).otherwise(kept))
    kept = first.groupBy(key).agg(fold.alias("_k")).select(key, F.explode("_k").alias("_d"))
    return df.join(first.join(kept, [key, "_d"], "left_semi"), order, "left_semi")


def top_per_day(df: DataFrame, day: str, score: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(day).orderBy(F.desc(score), order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def relative_target(df: DataFrame, least: int = 2) -> DataFrame:
    """1 for the best eligible trade of its (date, cluster); groups with too few take the winner of the date.

    Eligible: pnl over avg_sl, which is over 0; best by their ratio, then by symbol, then by row.
    """
    ok = (F.col("pnl") > F.col("avg_sl")) & (F.col("avg_sl") > 0)
    df = df.withColumn("_ok", ok).withColumn("_ratio", F.when(ok, F.col("pnl") / F.col("avg_sl")))
    by = [F.desc_nulls_last("_ratio"), F.col("symbol"), F.col("row_id")]
    local, whole = Window.partitionBy("date", "cluster"), Window.partitionBy("date")
    n = F.count_if("_ok").over(local)
    first = F.when(n >= least, F.row_number().over(local.orderBy(*by)) == 1).when(n >= 1, F.row_number().over(whole.orderBy(*by)) == 1).otherwise(F.lit(False))
    return df.withColumn("target", (F.col("_ok") & first).cast("int")).withColumn("local", (n >= least).cast("int")).drop("_ok", "_ratio")


def forward_folds(days: DataFrame, day: str, first: int = 252, block: float = 0.1, least: int = 90, most: int = 4) -> DataFrame:
    """Anchored folds over the distinct days: (fold, train_end, test_start, test_end) by day number."""
    one = days.select(F.col(day).alias("d")).distinct().agg(F.sort_array(F.collect_set("d")).alias("d"))
    n = F.size("d")
    size = F.greatest(F.floor(n * block).cast("int"), F.lit(least))
    folds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.struct(k.alias("fold"), (first + k * size).alias("at"))), lambda f: f["at"] + size <= n)
    return one.select("d", size.alias("size"), F.explode(folds).alias("f")).select(
        F.col("f.fold").alias("fold"), F.get("d", F.col("f.at") - 1).alias("train_end"), F.get("d", F.col("f.at")).alias("test_start"), F.get("d", F.col("f.at") + F.col("size") - 1).alias("test_end")
    )


def purged_folds(df: DataFrame, folds: int, embargo: float) -> DataFrame:
    """(row_id, pos, fold, n_train) of positional folds; rows next to a fold, by the embargo, are not trained on.

    Positions are over the whole table, by date, symbol and row_id. With fewer rows than folds each row is a fold.
    """
    df = df.select("row_id", "date", "symbol", F.lit(1).cast("long").alias("_one"))
    df = prefix_sum(df, [], [F.col("date"), F.col("symbol"), F.col("row_id")], "_one", "pos")
    n = df.count()
    size, gap = max(1, n // folds), max(1, int(n * embargo))
    fold = F.least(F.floor(F.col("pos") / size), F.lit(folds - 1)).cast("int")
    lo, hi = fold * size, F.when(fold == folds - 1, F.lit(n)).otherwise((fold + 1) * size)
    held = F.least(hi + gap, F.lit(n)) - F.greatest(lo - gap, F.lit(0))
    return df.select("row_id", "pos", fold.alias("fold"), (n - held).cast("long").alias("n_train"))
