"""Embedding near-duplicates by an exact metric range join.

Cosine at or above a limit is a Euclidean distance up to a radius between unit vectors. Pivots partition them: a
vector's home is the cell of its nearest pivot. A vector x within the radius of a vector y whose home is cell j must
obey what the triangle inequality says of x and j: x is no farther than the radius beyond the face between its own
cell and j, and its distance to pivot j differs from y's by the radius at most. So x visits just the cells, and the
rings of distances to their pivots, for which both hold; every other cell holds no partner of x.

The links of a vector are counted in its home, where all its partners live or visit. A home block holds BLOCK vectors
at most, and its visitors pass by in batches, so memory doesn't grow with the data; blocks are joined independently.
Equal vectors are one vector with a count, so copies cost nothing. In data without any structure a radius of 0.32
reaches most cells whatever the pivots, and the work is that of all pairs, shared out by blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, hashed_sample, join_by_weight, table
from tidemark.llm.components import components

LIMIT = 0.95
#: Vectors a cell should hold, and a block does at most but for chance; most pivots, and most bytes of them; rings a radius.
CELL = 4096
MAX_CELLS = 1024
PIVOT_BYTES = 1 << 26
RINGS = 4
BATCH = 1024
#: Vectors whose visits are worked out at a time.
SLICE = 128
#: Bounds are widened by this, and cosines this near the limit are worked out again in exact sums.
SLACK = 1e-9
_FOUND = "a binary, b binary, n long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, vec): the components as doubles, and a key of them; both null if the vector can link with nothing."""
    for batch in batches:
        keys, data = [], []
        for x in batch.column(1):
            # nulls within become NaN
            v = None if not x.is_valid else np.asarray(x.values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype="<f8") + 0.0
            good = v is not None and bool(np.isfinite(v).all()) and bool(v.any())
            data.append(v.tobytes() if good else None)
            keys.append(hashlib.sha256(data[-1]).digest()[:16] if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "key", "vec"])


def _units(vecs: list[bytes]) -> np.ndarray:
    """Unit vectors of one length; scaled by powers of two first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(vecs), dtype="<f8").reshape(len(vecs), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


def _linked(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of a link with which of b."""
    cosines = a @ b.T
    out = cosines >= limit
    for i, j in np.argwhere(np.abs(cosines - limit) < SLACK):
        out[i, j] = _exact(a[i], b[j]) >= limit
    return out


class Cells:
    """Pivots by length of vectors, and the blocks of the cells that hold vectors."""

    def __init__(self, sample: list[bytes], limit: float):
        self.radius = math.sqrt(max(0.0, 2 - 2 * limit)) + SLACK
        self.width = max(self.radius / RINGS, 0.01)
        by: dict[int, list[bytes]] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        self.pivots = {size: _units(own) for size, own in by.items()}
        self.apart = {size: np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-300)) for size, p in self.pivots.items()}
        #: Cell, first and last ring, and parts of every block, by length.
        self.blocks: dict[int, tuple[np.ndarray, ...]] = {}

    def _of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.pivots:  # a length that the sample lacks has one cell
            return np.eye(1, size // 8), np.zeros((1, 1))
        return self.pivots[size], self.apart[size]

    def home(self, size: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosines with all pivots, cells and rings of unit vectors."""
        cosines = x @ self._of(size)[0].T
        cell = cosines.argmax(axis=1)
        away = np.sqrt(np.maximum(2 - 2 * cosines[np.arange(len(x)), cell], 0))
        return cosines, cell, np.floor(away / self.width).astype(np.int64)

    def hold(self, rows: list, most: int) -> Cells:
        """Takes in how many vectors (size, cell, ring, n) the rings have.

        Neighbouring rings of a cell become one block of ``most`` vectors at most; a fuller ring is cut into parts.
        """
        by: dict[int, list[list[int]]] = {}
        for r in sorted(rows):
            own = by.setdefault(r.size, [])
            if own and own[-1][0] == r.cell and own[-1][3] + r.n <= most:
                own[-1][2:] = [r.ring, own[-1][3] + r.n]
            else:
                own.append([r.cell, r.ring, r.ring, r.n])
        self.blocks = {size: tuple(np.array(own, dtype=np.int64).T) for size, own in by.items()}
        self.blocks = {size: (cell, first, last, -(-n // most)) for size, (cell, first, last, n) in self.blocks.items()}
        return self

    def visits(self, size: int, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """For each vector, which of the blocks of its length may have a partner."""
        pivots, apart = self._of(size)
        own, cosines = np.arange(len(cell)), x @ pivots.T
        beyond = cosines[own, cell][:, None] - cosines <= self.radius * apart[cell] + SLACK
        away = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        cells, first, last, _ = self.blocks[size]
        low, high = away[:, cells] - self.radius, away[:, cells] + self.radius
        return beyond[:, cells] & (high >= first * self.width - SLACK) & (low <= (last + 1) * self.width + SLACK)


def _by_size(vecs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length in bytes, places and unit vectors of those of each length."""
    sizes = np.array([len(v) for v in vecs])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, _units([vecs[i] for i in at.tolist()])


def _homes(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_size(batch.column("vec").to_pylist()):
                _, cell, ring = cells.home(size, x)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.full(len(at), size)), pa.array(cell), pa.array(ring)], names=[*batch.schema.names, "size", "cell", "ring"])

    return run


def _placed(cells: Cells):
    """Rows for every block that a vector lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_cell, own_ring, own_hash = (batch.column(c).to_numpy() for c in ("cell", "ring", "hash"))
            for size, at, x in _by_size(batch.column("vec").to_pylist()):
                held, first, last, parts = cells.blocks[size]
                base = ((size * MAX_CELLS + held) << 30) + (first << 20)  # a number for each block
                for lo in range(0, len(at), SLICE):
                    rows = at[lo : lo + SLICE]
                    ring = own_ring[rows][:, None]
                    home = (held == own_cell[rows][:, None]) & (first <= ring) & (ring <= last)
                    i, r = np.nonzero(home | cells.visits(size, x[lo : lo + SLICE], own_cell[rows]))
                    each = np.repeat(np.arange(len(i)), parts[r])
                    part = np.arange(len(each)) - np.repeat(np.cumsum(parts[r]) - parts[r], parts[r])
                    i, r = i[each], r[each]
                    lives = home[i, r] & (part == own_hash[rows[i]] % parts[r])
                    yield pa.RecordBatch.from_arrays([pa.array(base[r] + part), pa.array(~lives), *[batch.column(c).take(pa.array(rows[i])) for c in ("key", "n", "vec")]], names=["block", "guest", "key", "n", "vec"])

    return run


class _Home:
    """The vectors of a block, their links with each other and with guests."""

    def __init__(self, keys: list[bytes], counts: list[int], vecs: list[bytes], limit: float):
        self.keys, self.limit, self.counts = keys, limit, np.array(counts, dtype=np.int64)
        self.x = _units(vecs)
        self.links = np.zeros(len(keys), dtype=np.int64)
        self.root = np.arange(len(keys))
        self.edges: list[tuple[bytes, bytes]] = []
        for lo in range(0, len(keys), BATCH):
            near = _linked(self.x[lo : lo + BATCH], self.x, limit)
            near[np.arange(len(near)), lo + np.arange(len(near))] = False
            self.links[lo : lo + BATCH] = near @ self.counts
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                self._join(keys[lo + i], np.append(np.flatnonzero(near[i]), lo + i))

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def _join(self, key: bytes, members: np.ndarray) -> None:
        """Links ``key`` with a member of each class that isn't known to be linked yet."""
        seen: dict[int, int] = {}
        for i in members.tolist():
            seen.setdefault(self._find(i), i)
        first = next(iter(seen))
        for r, i in seen.items():
            self.root[r] = first
            if self.keys[i] != key:
                self.edges.append((key, self.keys[i]))

    def guests(self, keys: list[bytes], counts: list[int], vecs: list[bytes]) -> None:
        near = _linked(_units(vecs), self.x, self.limit)
        self.links += np.array(counts, dtype=np.int64) @ near
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            self._join(keys[i], np.flatnonzero(near[i]))

    def found(self) -> Iterator[pa.RecordBatch]:
        """Counts (a, null, n) of the block's vectors and links (a, b, null) that span what is linked."""
        rows = [(k, None, n) for k, n in zip(self.keys, self.links.tolist()) if n] + [(a, b, None) for a, b in self.edges]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])


def _joined(limit: float):
    """Joins blocks whose rows come one block after another, its own vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, home = None, [], None
        for batch in batches:
            blocks, guests = batch.column("block").to_numpy(), batch.column("guest").to_numpy(zero_copy_only=False)
            keys, counts, vecs = (batch.column(c).to_pylist() for c in ("key", "n", "vec"))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(guests.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if blocks[lo] != block:
                    if home or own:
                        yield from (home or _Home(*zip(*own), limit)).found()
                    block, own, home = blocks[lo], [], None
                rows = list(zip(keys[lo:hi], counts[lo:hi], vecs[lo:hi]))
                if not guests[lo]:
                    own += rows
                    continue
                if not own:  # a part of a ring may have no vector by chance
                    continue
                home = home or _Home(*zip(*own), limit)
                for at in range(0, len(rows), BATCH):
                    home.guests(*zip(*rows[at : at + BATCH]))
        if home or own:
            yield from (home or _Home(*zip(*own), limit)).found()

    return run


def range_links(distinct: DataFrame, limit: float = LIMIT, cell: int = CELL) -> DataFrame:
    """Of distinct vectors (key, n, vec: n rows have it): (a, null, n) with the rows linked to a, and links (a, b, null) that span its class.

    Pivots are a sample by hash, of a size bounded by MAX_CELLS and PIVOT_BYTES; the rings that reach the driver are as
    few as the pivots and RINGS allow.
    """
    n = distinct.count()
    size = (distinct.agg(F.max(F.length("vec"))).first()[0] or 8) + 1
    sample = hashed_sample(distinct.select("key", "vec"), max(1, min(math.ceil(n / cell), MAX_CELLS, PIVOT_BYTES // size)), "key")
    cells = Cells([bytes(r.vec) for r in sample.collect()], limit)
    homes = distinct.select("key", "n", "vec", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("hash"))
    homes = checkpointed(homes.mapInArrow(_homes(cells), "key binary, n long, vec binary, hash long, size long, cell long, ring long"))
    cells.hold(homes.groupBy("size", "cell", "ring").agg(F.count("*").alias("n")).collect(), cell)
    spread = homes.mapInArrow(_placed(cells), "block long, guest boolean, key binary, n long, vec binary")
    return spread.repartition("block").sortWithinPartitions("block", "guest").mapInArrow(_joined(limit), _FOUND)


def near_vectors(vectors: DataFrame, limit: float = LIMIT, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding: an array of numbers).

    Vectors link if their cosine in double precision is ``limit`` or more. Null, empty and zero vectors, those with null
    or non-finite components, and vectors of different lengths link with nothing. Equal vectors link with each other.
    A null vec_id names a component only if it has no other, and is kept there; repeated rows all stay, and count as
    links of each other. Other columns are left out; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = checkpointed(rows.mapInArrow(_packed, "vec_id long, key binary, vec binary"))
    distinct = checkpointed(rows.where("key is not null").groupBy("key", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")))
    found = checkpointed(range_links(distinct.select("key", "n", "vec"), limit, cell))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
    labels = components(found.where("b is not null").select("a", "b"))
    marked = distinct.select("key", "n", "first").join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    marked = checkpointed(marked.select("key", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").alias("class")))
    # a class with many vectors meets its name as any hot key does
    names = marked.groupBy("class").agg(F.count("*").alias("vectors"), F.min("first").alias("component_id"))
    named = checkpointed(join_by_weight(marked.select("key", "n", "n_links", "class"), checkpointed(names), "class", "vectors").drop("class"))
    own = rows.select("vec_id", "key")
    linked = join_by_weight(own.where("key is not null"), named, "key", "n").select("vec_id", "n_links", "component_id")
    alone = own.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
