"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prefix import prefix_sum  # noqa: F401
from tidemark.sources.folders import checkpointed  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column: a null is empty, and bytes that are not UTF-8 become replacement characters."""
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def join_by_weight(rows: DataFrame, named: DataFrame, key: str, weight: str, hot: int = 200) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which has each key once and in ``weight`` how many of ``rows`` have it.

    Keys with more than one in ``hot`` of all rows, of which there are fewer than ``hot``, are broadcast; the others are
    dealt by key, so that no key brings more than that share to a task. Both sides are read twice: checkpoint them.
    """
    total = named.agg(F.sum(weight)).first()[0] or 0
    named, heavy = named.drop(weight), named.where(F.col(weight) * hot > total).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(named, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def hashed_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``columns``, which should be a key.

    A bound on the hash leaves about four times as many candidates in the whole table, however many partitions it has,
    before the last are chosen in one task.
    """
    total, span = df.count(), 1 << 40
    place = F.pmod(F.xxhash64(*columns), F.lit(span))
    return df.where(place <= int(span * min(1.0, (4 * n + 100) / max(total, 1)))).orderBy(place, *columns).limit(n)
