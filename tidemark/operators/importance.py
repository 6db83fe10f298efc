"""Importance of clusters of features by joint permutation of their columns over the validation rows.

A permutation is a keyed bijection of row positions, worked out per row, so no rows are sorted for it; a cluster's
columns come from the row at the permuted place, all together, by one join for all clusters and repeats. A forest tells
values apart by its thresholds alone, so rows go into that join as the numbers of their cells between thresholds, packed
into a word, and are counted after it: the forest scores each cell once. Areas under the curve of all of them are one
grouped aggregate of the counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.information import auc
from tidemark.operators.prefix import prefix_sum
from tidemark.sources.folders import checkpointed

ROUNDS = 12
#: Of XXH64.
PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)
#: Loss of area above which a cluster counts, and clusters that must.
MEANINGFUL, CLUSTERS = 0.002, 3


def permuted(pos: Column, n: int, *key: Column) -> Column:
    """A bijection of 0 .. n - 1 that the key names: in each round a place and its mirror about a random point swap or stay together."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(1), *key, r), F.lit(n)) - x, F.lit(n))
        low, high = F.least(x, mirror), F.greatest(x, mirror)
        return F.when(F.pmod(F.xxhash64(F.lit(2), *key, r, high, low), F.lit(2)) == 0, x).otherwise(mirror)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), pos.cast("long"), swap)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * PRIMES[1]
    h = (h ^ h >> np.uint64(29)) * PRIMES[2]
    return h ^ h >> np.uint64(32)


def _hash_int(value: int, h: np.ndarray) -> np.ndarray:
    """XXH64 of an int under a seed, as xxhash64 has it."""
    h = h + PRIMES[4] + np.uint64(4) ^ np.array([value & 0xFFFFFFFF], dtype=np.uint64) * PRIMES[0]
    return _mixed(_turned(h, 23) * PRIMES[1] + PRIMES[2])


def _hash_long(value: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h + PRIMES[4] + np.uint64(8) ^ _turned(value.astype(np.uint64) * PRIMES[1], 31) * PRIMES[0]
    return _mixed(_turned(h, 27) * PRIMES[0] + PRIMES[3])


def permuted_places(pos: np.ndarray, n: int, *key: int) -> np.ndarray:
    """``permuted`` of many positions (longs) under one key of ints."""

    def keyed(*values: int) -> np.ndarray:
        h = np.full(1, 42, dtype=np.uint64)
        for v in values:
            h = _hash_int(v, h)
        return h

    x = pos
    for r in range(ROUNDS):
        mirror = int(keyed(1, *key, r).astype(np.int64)[0]) % n - x
        mirror[mirror < 0] += n
        high = _hash_long(np.maximum(x, mirror), keyed(2, *key, r))
        x = np.where(_hash_long(np.minimum(x, mirror), high) & np.uint64(1), mirror, x)
    return x


def _sent(n: int, seed: int, tags: list[tuple[int, int]]):
    """Each row once for each tag, with the place ``_from`` that it takes columns from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tag in enumerate(tags):
                made = [pa.array(permuted_places(pos, n, seed, *tag)), pa.array(np.full(len(pos), k, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], names=["_from", "_tag", *batch.schema.names[1:]])

    return run


#: Bits of a word that holds the cells of features.
WORD = 62


class Cells:
    """The cells between a forest's thresholds: a feature is the number of thresholds below it, some features a word."""

    def __init__(self, model, columns: list[str]) -> None:
        told = model.toDebugString
        if " in {" in told:
            raise ValueError("features must be numbers, not categories")
        cuts: list[set[float]] = [set() for _ in columns]
        for k, t in re.findall(r"feature (\d+) <= ([^)\s]+)\)", told):
            cuts[int(k)].add(float(t))
        self.model, self.columns, self.cuts = model, columns, [sorted(c) for c in cuts]
        self.at, used = {}, [0]  # word and first bit of each feature
        for c, own in zip(columns, self.cuts):
            bits = len(own).bit_length()
            if used[-1] + bits > WORD:
                used.append(0)
            self.at[c] = (len(used) - 1, used[-1], bits)
            used[-1] += bits
        self.words = [f"_word{k}" for k in range(len(used))]

    def pack(self) -> list[Column]:
        """The words, as columns of the features."""
        cell = {c: sum(((F.col(c) > t).cast("long") for t in own), F.lit(0).cast("long")) for c, own in zip(self.columns, self.cuts)}
        parts = [[F.shiftleft(cell[c], self.at[c][1]) for c in self.columns if self.at[c][0] == k] for k in range(len(self.words))]
        return [sum(own, F.lit(0).cast("long")).alias(w) for own, w in zip(parts, self.words)]

    def mask(self, own: list[str], k: int) -> int:
        """The bits of features ``own`` in word ``k``."""
        return sum(((1 << bits) - 1) << lo for c, (word, lo, bits) in self.at.items() if c in own and word == k)

    def score(self, words: DataFrame) -> DataFrame:
        """Distinct ``words`` with ``_p``, the chance that the forest gives to all values of their cells."""
        values = []
        for c, own in zip(self.columns, self.cuts):
            word, lo, bits = self.at[c]
            cell = F.shiftright(F.col(self.words[word]), lo).bitwiseAND(F.lit((1 << bits) - 1))
            inside = [*own, math.nextafter(own[-1], math.inf)] if own else [0.0]  # a value of each cell
            values.append(F.get(F.array(*map(F.lit, inside)), cell.cast("int")).alias(c))
        vectors = VectorAssembler(inputCols=self.columns, outputCol="_features").transform(words.select(*self.words, *values))
        return self.model.transform(vectors).select(*self.words, F.get(vector_to_array("probability"), F.lit(1)).alias("_p"))


def _fit(train: DataFrame, columns: list[str], label: str, trees: int, depth: int, seed: int):
    vectors = VectorAssembler(inputCols=columns, outputCol="_features").transform(train)
    return RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=20, seed=seed).fit(vectors)


def permutation_losses(model, rows: DataFrame, columns: list[str], label: str, groups: dict[int, list[str]], repeats: int, seed: int) -> DataFrame:
    """(grp, repeat, loss): area that ``model`` loses on ``rows`` (pos from 0, columns, label) with a group's columns permuted together."""
    n, cells = rows.count(), Cells(model, columns)
    packed = rows.select("pos", label, *cells.pack())
    tags = [(g, r) for g in groups for r in range(repeats)]
    schema = T.StructType([T.StructField("_from", T.LongType()), T.StructField("_tag", T.IntegerType()), *packed.schema.fields[1:]])
    spread = packed.mapInArrow(_sent(max(1, n), seed, tags), schema)
    source = packed.select(F.col("pos").alias("_from"), *[F.col(w).alias(f"_o{w}") for w in cells.words])
    moved = {}
    for k, w in enumerate(cells.words):
        taken = F.get(F.array(*[F.lit(cells.mask(groups[g], k)).cast("long") for g, _ in tags]), F.col("_tag"))
        moved[w] = F.col(w).bitwiseXOR(F.col(w).bitwiseXOR(F.col(f"_o{w}")).bitwiseAND(taken))
    own = [F.struct(F.lit(g).alias("grp"), F.lit(r).alias("repeat")) for g, r in tags]
    mixed = spread.join(source.hint("shuffle_hash"), "_from").select("_tag", label, *[c.alias(w) for w, c in moved.items()])
    plain = packed.select(F.lit(-1).alias("_tag"), label, *cells.words)
    counts = checkpointed(mixed.union(plain).groupBy("_tag", label, *cells.words).agg(F.count("*").alias("_n")))
    scored = counts.join(cells.score(counts.select(*cells.words).distinct()), cells.words)
    areas = checkpointed(auc(scored, "_p", F.col(label) == 1, ["_tag"], "_n"))  # a row per permutation, and one for none
    base = areas.where("_tag < 0").select(F.col("auc").alias("_base"))
    named = areas.where("_tag >= 0").withColumn("_t", F.get(F.array(*own), F.col("_tag"))).select("_t.*", "auc")
    return named.join(F.broadcast(base)).select("grp", "repeat", (F.col("_base") - F.col("auc")).alias("loss"), F.col("_base").alias("base"))  # one row


def clustered_importance(train: DataFrame, held: DataFrame, key: str, clusters: dict[int, list[str]], label: str, repeats: int = 30, within: int = 20, trees: int = 40, seed: int = 42) -> DataFrame:
    """A row per feature: cluster, its loss (mean, deviation), the feature's share within it, and their product.

    A forest is fit on ``train``; the loss is that of its area on ``held``. Shares come from a forest on the cluster's
    columns alone, by permuting one at a time: losses below 0 count as 0; a feature alone has all. ``status`` is PASS if
    three clusters lose more than 0.002. ``key`` orders the rows of ``held`` and should name each once; nulls in a feature
    or the label leave a row out. A held table of one class has null losses. There is a model per cluster: clusters are
    bounded by features.
    """
    columns = [c for own in clusters.values() for c in own]
    train = checkpointed(train.select(*columns, F.col(label).cast("double").alias(label)).dropna())
    held = held.select(F.col(key).alias("_key"), *columns, F.col(label).cast("double").alias(label), F.lit(1).cast("long").alias("_one")).dropna()
    rows = checkpointed(prefix_sum(held, [], [F.col("_key")], "_one", "pos").drop("_key", "_one"))
    losses = permutation_losses(_fit(train, columns, label, trees, 6, seed), rows, columns, label, clusters, repeats, seed)
    whole = losses.groupBy("grp").agg(F.avg("loss").alias("loss_mean"), F.stddev_pop("loss").alias("loss_std"), F.first("base").alias("auc_base"))
    shares = None
    for c, own in clusters.items():
        if len(own) == 1:
            each = train.sparkSession.range(1).select(F.lit(c).alias("grp"), F.lit(own[0]).alias("feature"), F.lit(1.0).alias("share"))
        else:
            numbered = dict(enumerate([x] for x in own))
            lost = permutation_losses(_fit(train, own, label, trees, 4, seed), rows, own, label, numbered, within, seed + 1)
            lost = lost.groupBy(F.get(F.array(*[F.lit(x) for x in own]), "grp").alias("feature")).agg(F.avg("loss").alias("l"))
            total = lost.agg(F.greatest(F.sum("l"), F.lit(1e-10)).alias("t"))
            each = lost.join(F.broadcast(total)).select(F.lit(c).alias("grp"), "feature", (F.greatest("l", F.lit(0.0)) / F.col("t")).alias("share"))  # one row
        shares = each if shares is None else shares.union(each)
    out = shares.join(F.broadcast(whole), "grp")  # a row per cluster
    enough = whole.agg(F.when(F.count_if(F.col("loss_mean") > MEANINGFUL) >= CLUSTERS, "PASS").otherwise("FAIL").alias("status"))
    final = F.greatest("loss_mean", F.lit(0.0)) * F.col("share")
    return out.join(F.broadcast(enough)).select(F.col("grp").alias("cluster"), "feature", "auc_base", "loss_mean", "loss_std", "share", final.alias("importance"), "status")  # one row
