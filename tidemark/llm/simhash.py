"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint carries its Hamming distances to a set of reference fingerprints (pivots). As distances obey
the triangle inequality, two fingerprints within the limit differ by no more than the limit in any of those distances;
pairs that do are discarded without being compared, and the survivors are verified bit by bit.

The pairs that the tables judge come from blocks of the fingerprint: of ``limit + c`` blocks, two fingerprints within
the limit share c whole ones. Each choice of c blocks is one table keyed by those bits; the number of blocks grows with
the number of fingerprints, so that a key holds a few of them. A key that still holds many is cut into chunks, and each
pair of chunks is a group of its own. Groups return links that span their components, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.components import components

LIMIT = 4
SHINGLE = 4
SEED = 42
PIVOTS = 16
CHUNK = 1024
SALTS = 32
_BATCH_WORDS = 200_000


def text_fingerprint(data: bytes) -> int:
    """The fingerprint of a text in UTF-8: bit k is 1 if set in over half the hashes of its shingles."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    ones, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BATCH_WORDS):  # long texts a part at a time
        to = min(n, at + _BATCH_WORDS)
        own = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())]
        bits = np.unpackbits(np.array(own, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at).cast(pa.large_binary())
            found = np.array([text_fingerprint(x.as_py() or b"") for x in column], dtype=np.uint64).view(np.int64)
            rest = [i for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(found)], names=[batch.schema.names[i] for i in rest] + [out])

    return run


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The columns of ``docs`` with ``text`` replaced by its 64-bit fingerprint as a long; null and wordless texts get 0.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are 4 words joined by spaces (the whole
    sequence, if fewer), repeats counted; their hash is XXH64 with seed 42.
    """
    from pyspark.sql import types as T

    kept = docs.drop(out) if out != text else docs
    schema = T.StructType([f for f in kept.schema.fields if f.name != text] + [T.StructField(out, T.LongType())])
    return kept.mapInArrow(_fingerprints(text, out), schema)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a fixed rule: hashes of their numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(k), SEED)).astype(np.int64)) for k in range(n)]


def _packed_distances(fp: Column, refs: list[int]) -> Column:
    """Distances to 8 pivots, a byte each."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(refs):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * k))
    return out


def blocks(n: int, limit: int = LIMIT) -> list[int]:
    """Masks of the keys for ``n`` fingerprints, each of whole blocks; they have about as many bits as n."""
    count = limit + 1
    while 64 * (count - limit) / count < np.log2(max(n, 2)) - 2 and count < 16:
        count += 1
    edges = np.linspace(0, 64, count + 1).round().astype(int)
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(parts, count - limit)]


def _spanning(fps: np.ndarray, table: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that span the components of fingerprints within the limit of each other."""
    n = len(fps)
    parent = np.arange(n)
    links = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    order = np.argsort(table[:, 0], kind="stable")  # a window of the first distance holds all partners
    fps, table = fps[order], table[order]
    for i in range(n - 1):
        to = int(np.searchsorted(table[:, 0], table[i, 0] + limit, "right"))
        near = i + 1 + np.flatnonzero(np.abs(table[i + 1 : to] - table[i]).max(axis=1) <= limit) if to > i + 1 else ()
        if not len(near):
            continue
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= limit]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((int(fps[i].astype(np.int64)), int(fps[j].astype(np.int64))))
    return links


def _links(limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[int, int]] = []
            for members in frame["members"]:
                rows = np.array([(m["fp"], m["near"], m["far"]) for m in members], dtype=np.int64)
                table = np.ascontiguousarray(rows[:, 1:]).view(np.uint8).reshape(len(rows), -1).astype(np.int16)
                out += _spanning(rows[:, 0].copy().view(np.uint64), table, limit)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def fingerprint_links(fps: DataFrame, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column ``fp`` that connect all those within the limit."""
    refs = pivots()
    rows = fps.select("fp", _packed_distances(F.col("fp"), refs[:8]).alias("near"), _packed_distances(F.col("fp"), refs[8:]).alias("far"))
    masks = blocks(fps.count(), limit)
    keyed = rows.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("kind", "key"))
    crowd = keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(crowd, ["kind", "key"])
    # a crowded key becomes chunks by hash; each pair of chunks is a group
    parts = shared.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = paired.groupBy("kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("fp", "near", "far")).alias("members")
    )
    return grouped.select("members").where(F.size("members") > 1).mapInPandas(_links(limit), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: the class of texts linked, directly or not, within the limit.

    component_id is the smallest doc_id of the class. Copies of one fingerprint are one node of the graph, so a group of
    any size costs as one text. Null texts have fingerprint 0 and are linked as any other; null ids never name a class
    unless it has no other; repeated rows stay, in one class. An empty table gives no rows.
    """
    marked = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp"))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = checkpointed(_classes(distinct, limit))
    # the members of a large class meet its name in SALTS tasks; fingerprints without links are named by themselves
    linked = classes.where("linked").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    firsts = linked.groupBy("class", "salt").agg(F.min("first").alias("first")).groupBy("class").agg(F.min("first").alias("component_id"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = linked.join(firsts, ["class", "salt"]).select("fp", "component_id").union(classes.where("not linked").select("fp", "first"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _classes(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(fp, first, class, linked) for the distinct fingerprints ``fp``: a class is named by its smallest fingerprint."""
    labels = components(fingerprint_links(distinct, limit))
    return distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("class"), F.col("component").isNotNull().alias("linked"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates, the one with the smallest doc_id, with the columns of ``docs``.

    Rows with a null doc_id go where a class has another. Of rows that share a doc_id within a class, the one with the
    smallest hash of its columns stays; in different classes each has its own.
    """
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    parts = [x for name in hashed for x in (F.col(name).isNull(), F.col(name))]
    keys = ["_tidemark_a", "_tidemark_b"]
    marks = [F.xxhash64(*parts).alias(keys[0]), F.xxhash64(F.lit(1), *parts).alias(keys[1])]
    rows = fingerprints(docs.select("doc_id", "text", *marks), "text", "fp")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *keys)
    distinct = checkpointed(rows.groupBy("fp").agg(F.min(place).alias("first")))
    salted = _classes(distinct).groupBy("class", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")).agg(F.min("first").alias("first"))
    keepers = salted.groupBy("class").agg(F.min("first").alias("first")).select(*[f"first.{k}" for k in keys])
    # one exchange by that key serves the join and what follows it
    return docs.select("*", *marks).join(keepers, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
