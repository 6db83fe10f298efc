"""Running values over an order that one task cannot hold: of the whole table, or of keys with most of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.folders import checkpointed


def _dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` dealt by range over (keys, order) and kept, with the number of its partition in ``_part``."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys], *order)
    return checkpointed(dealt.withColumn("_part", F.spark_partition_id()))


def _same(keys: list[str]) -> Column:
    """Rows o meet the totals t of their partition and keys."""
    same = F.col("o._part") == F.col("t._part")
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}"))
    return same


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple]) -> DataFrame:
    """Adds, for each ``out: (stat, column, start)``, the stat over the rows of the same keys earlier in ``order``.

    ``stat`` is F.sum, F.max or F.min; the first row gets ``start`` (null: none). Rows are dealt by range over (keys,
    order), so that one key may span many partitions; each partition runs over its own rows and adds what the partitions
    before it come to. Without keys the run is over the whole table. Rows that tie in ``order`` should be alike, as
    their order is open.
    """
    dealt = _dealt(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[stat(c).over(inside).alias(f"_own_{out}") for out, (stat, c, _) in values.items()])
    # one row for each key and partition that holds it
    totals = dealt.groupBy("_part", *keys).agg(*[stat(c).alias(f"_all_{out}") for out, (stat, c, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *keys, *[stat(f"_all_{out}").over(before).alias(f"_before_{out}") for out, (stat, _, _) in values.items()])

    def both(out: str, stat, start) -> Column:
        a, b = F.col(f"o._own_{out}"), F.col(f"t._before_{out}")
        joined = a + b if stat is F.sum else F.greatest(a, b) if stat is F.max else F.least(a, b)
        return F.coalesce(joined, a, b, F.lit(start)).alias(out)

    return own.alias("o").join(totals.alias("t"), _same(keys)).select(*[F.col(f"o.{c}") for c in df.columns], *[both(out, stat, start) for out, (stat, _, start) in values.items()])


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come earlier in ``order`` (0 for the first)."""
    return running(df, keys, order, {out: (F.sum, value, 0)})


def running_path(df: DataFrame, keys: list[str], order: list[Column], step: str, level: str, top: str) -> DataFrame:
    """Adds ``level``, the sum of ``step`` up to and with the row, and ``top``, the largest level so far, 0 at least.

    Both come from one deal of the rows, as ``running`` deals them: a partition's path starts where those before it end,
    and the top of each is known from its own. A null step is 0.
    """
    dealt = _dealt(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_sum", F.sum(F.coalesce(step, F.lit(0.0))).over(inside))
    own = own.withColumn("_high", F.max("_sum").over(inside))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("_part", *keys).agg(F.sum(F.coalesce(step, F.lit(0.0))).alias("_all"), F.max("_sum").alias("_most"))
    totals = totals.withColumn("_from", F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    totals = totals.withColumn("_past", F.max(F.col("_from") + F.col("_most")).over(before))
    reached = F.greatest(F.lit(0.0), F.col("t._from") + F.col("o._high"), F.col("t._past"))
    return own.alias("o").join(totals.alias("t"), _same(keys)).select(*[F.col(f"o.{c}") for c in df.columns], (F.col("t._from") + F.col("o._sum")).alias(level), reached.alias(top))
