"""Row-based time-series windows: returns, rolling and exponential statistics, as-of values, cross-sectional ranks.

Frames count rows. A statistic is null until enough non-null values are in its frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EWM_BLOCK = 1024


def series(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def log_return(x: Column, w: WindowSpec, rows: int = 1) -> Column:
    return F.ln(F.try_divide(x, F.lag(x, rows).over(w)))


def change(x: Column, w: WindowSpec, rows: int) -> Column:
    """x over its value some rows before, less one, where that is above 0."""
    before = F.lag(x, rows).over(w)
    return F.when(before > 0, x / before - 1)


def rolling(stat, x: Column, w: WindowSpec, rows: int, least: int) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) >= least, stat(x).over(frame))


def fracdiff_weights(d: float, tau: float = 1e-5, most: int = 10_000) -> list[float]:
    """Weights of fractional differencing, the latest first: 1, then -w (d - k + 1) / k until one is below ``tau``."""
    out = [1.0]
    for k in range(1, most):
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < tau:
            break
        out.append(w)
    return out


def window_weights(d: Column, n: int) -> Column:
    """The first ``n`` weights of fractional differencing of order ``d``, the latest first."""
    step = lambda done, k: F.array_append(done, -F.element_at(done, -1) * (d - k + 1) / k)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(F.lit(1.0)), step) if n > 1 else F.array(F.lit(1.0))


def weights_summary(d: Column, tau: float, most: int = 10_000) -> Column:
    """(n, total, highest, lowest) of the sizes of the weights of order ``d`` until one is below ``tau``; none is held."""
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(False).alias("done"), F.lit(1).alias("n"), F.lit(1.0).alias("total"), F.lit(1.0).alias("highest"), F.lit(1.0).alias("lowest"))

    def step(x: Column, k: Column) -> Column:
        w = -x["w"] * (d - k + 1) / k
        size = F.abs(w)
        more = F.struct(w.alias("w"), F.lit(False).alias("done"), (x["n"] + 1).alias("n"), (x["total"] + size).alias("total"), F.greatest(x["highest"], size).alias("highest"), F.least(x["lowest"], size).alias("lowest"))
        return F.when(x["done"], x).when(size < tau, x.withField("done", F.lit(True))).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most - 1)), begin, step)


def ewm(df: DataFrame, key: str, order: str, x: str, span: int, least: int, out: str, std: bool = False) -> DataFrame:
    """Adds the exponentially weighted mean of ``x`` (or its unbiased standard deviation), with adjusted weights.

    Weights are powers that grow with the row number; rows go in blocks so that they stay finite, and the block before
    is carried on (those before weigh under 1e-40). Rows without a value keep their place and carry the last result.
    """
    decay = 1 - 2 / (span + 1)
    w = series([key], order)
    df = df.withColumn("_n", F.row_number().over(w) - 1)
    df = df.withColumn("_block", F.floor(F.col("_n") / EWM_BLOCK)).withColumn("_w", F.when(F.col(x).isNotNull(), F.pow(F.lit(decay), -(F.col("_n") % EWM_BLOCK))))
    sums = {"_s0": F.col("_w"), "_s1": F.col("_w") * F.col(x), "_s2": F.col("_w") * F.col(x) * F.col(x), "_q": F.col("_w") * F.col("_w")}
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = df.groupBy(key, (F.col("_block") + 1).alias("_block")).agg(*[F.sum(v).alias("p" + n) for n, v in sums.items()])
    df = df.select("*", *[F.sum(v).over(inside).alias("i" + n) for n, v in sums.items()]).join(whole, [key, "_block"], "left")
    at = {n: F.coalesce(F.col("i" + n), F.lit(0.0)) + F.coalesce(F.col("p" + n), F.lit(0.0)) * decay ** (EWM_BLOCK * (2 if n == "_q" else 1)) for n in sums}
    mean = at["_s1"] / at["_s0"]
    scale = at["_s0"] * at["_s0"] / (at["_s0"] * at["_s0"] - at["_q"])
    value = F.sqrt(F.greatest((at["_s2"] / at["_s0"] - mean * mean) * scale, F.lit(0.0))) if std else mean
    seen = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    names = [c for c in df.columns if c not in {"_n", "_block", "_w"} and c[1:] not in sums]
    return df.select(*names, F.when(seen >= max(least, 2 if std else 1), value).alias(out))


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``left`` with the columns of the latest row of ``right`` that is not later, nulls stored there included."""
    a = left.withColumn("_flag", F.lit(1)).withColumn("_got", F.lit(None))
    packed = right.select(key, order, F.lit(0).alias("_flag"), F.struct(*columns).alias("_got"))
    both = a.drop("_got").unionByName(packed, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_flag").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_got", F.last("_got", ignorenulls=True).over(w)).where("_flag = 1")
    return got.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in columns])


def percent_rank_average(x: Column, keys: list[str]) -> Column:
    """(average rank - 1) / (n - 1) over the non-null values of the group; one value ranks 0.5."""
    n = F.count(x).over(Window.partitionBy(*keys))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last()))
    return F.when(x.isNull(), None).when(n == 1, 0.5).otherwise((rank + (ties - 1) / 2 - 1) / (n - 1))


def winsorize(x: Column, keys: list[str], low: float = 0.01, high: float = 0.99) -> Column:
    w = Window.partitionBy(*keys)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.percentile(x, F.lit(high)).over(w)), F.percentile(x, F.lit(low)).over(w)))
