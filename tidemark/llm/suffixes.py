"""Benchmark decontamination with suffix arrays of the training text.

A shard is a run of documents inside a task. Each shard gets a suffix array over its words, kept to the suffixes whose
opening words also open some benchmark suffix, as no other suffix can hold a window. Every benchmark suffix is
binary-searched in each shard; windows that occur on one diagonal are merged into maximal verbatim matches with their
places. Documents are never shuffled, and a large benchmark is searched in blocks of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
OPENING = 4
BLOCK_CHARS = 16_000_000
SHARD_BYTES = 8_000_000
HASH_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, a-z and all of multi-byte characters; others map to 0.
_WORD = np.where((_LOWER >= 0x80) | ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)), _LOWER, 0).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
MATCH = T.ArrayType(T.StructType([T.StructField("item", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("item_word", "doc_word", "n_words")]))
SUMMARY = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest", T.LongType()),
        T.StructField("matches", MATCH),
    ]
)


class _Hasher:
    """64-bit ids of the words of a byte buffer, by differences of a running polynomial."""

    def __init__(self) -> None:
        self.n, self.power, self.inverse = 0, None, None

    def _grow(self, n: int) -> None:
        if n > self.n:
            mask = (1 << 64) - 1
            self.n = n
            self.power = np.full(n, _BASE, dtype=np.uint64)
            self.inverse = np.full(n, pow(_BASE, -1, mask + 1), dtype=np.uint64)
            self.power[0] = self.inverse[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            np.multiply.accumulate(self.inverse, out=self.inverse)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where the words of each text begin among them; no word spans two texts."""
        low = _WORD[data]
        inside = low != 0
        first = np.empty(len(data), dtype=bool)
        last = np.empty(len(data), dtype=bool)
        if len(data):
            first[0], last[-1] = inside[0], inside[-1]
            first[1:] = inside[1:] & ~inside[:-1]
            last[:-1] = inside[:-1] & ~inside[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            first[cuts] = inside[cuts]
            last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        ids = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):  # a slice of whole words at a time, so that long texts need little memory
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            self._grow(hi - lo + 1)
            run = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(low[lo:hi].astype(np.uint64) * self.power[: hi - lo], out=run[1:])
            s = starts[at:to] - lo
            ids[at:to] = (run[ends[at:to] - lo] - run[s]) * self.inverse[s]
            at = to
        ids ^= ids >> np.uint64(31)
        ids *= np.uint64(0xBF58476D1CE4E5B9)
        ids ^= ids >> np.uint64(29)
        ids[ids == 0] = 1  # 0 stands for the end of a text
        return ids, np.searchsorted(starts, offsets, "left")


def _opening(ids: np.ndarray, k: int) -> np.ndarray:
    """An id of the k words from each place on."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = ids[:n].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + ids[j : n + j]
    return out


def _rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that compare in the same order."""
    return np.ascontiguousarray(matrix.astype(">u8")).view(f"S{8 * matrix.shape[1]}").ravel()


def benchmark_index(items: list[tuple[str, str]]) -> dict:
    """The distinct windows of a block of items: keys to search for, and the (item, place) of each."""
    texts = [(t or "").encode() for _, t in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids, begin = _Hasher().words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    names = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    found: dict[bytes, list[tuple[int, int]]] = {}
    for k, (item, _) in enumerate(items):
        own = ids[begin[k] : begin[k + 1]]
        size = min(WINDOW, len(own))
        for p in range(len(own) - size + 1 if size else 0):
            found.setdefault(own[p : p + size].astype(">u8").tobytes(), []).append((number[item], p))
    keys = sorted(found)
    sizes = np.array([len(k) // 8 for k in keys], dtype=np.int64)
    openings = {}
    for k in range(1, OPENING + 1):
        these = [x for x, n in zip(keys, sizes) if min(n, OPENING) == k]
        if these:
            words = np.array([np.frombuffer(x[: 8 * k], dtype=">u8").astype(np.uint64) for x in these])
            openings[k] = np.unique(np.concatenate([_opening(w, k) for w in words]))
    return {
        "names": names,
        "low": np.array([k.ljust(8 * WINDOW, b"\0") for k in keys], dtype=f"S{8 * WINDOW}"),
        "high": np.array([k.ljust(8 * WINDOW, b"\xff") for k in keys], dtype=f"S{8 * WINDOW}"),
        "sizes": sizes,
        "openings": openings,
        "first": np.concatenate([[0], np.cumsum([len(found[k]) for k in keys])]).astype(np.int64),
        "places": np.array([x for k in keys for x in found[k]], dtype=np.int64).reshape(-1, 2),
    }


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, its ``count`` numbers from ``first`` on: (owner, number)."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def suffix_array(ids: np.ndarray, ends: np.ndarray, openings: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that open as a benchmark suffix does, sorted by their first words, and those words as keys."""
    keep = np.zeros(len(ids), dtype=bool)
    for k, wanted in openings.items():
        own = _opening(ids, k)
        bits = max(16, min(24, int(len(wanted)).bit_length() + 5))
        shift = np.uint64(64 - bits)
        hint = np.zeros(1 << bits, dtype=bool)
        hint[(wanted >> shift).astype(np.int64)] = True
        may = np.flatnonzero(hint[(own >> shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, own[may]), len(wanted) - 1)
        keep[may[wanted[at] == own[may]]] = True
    places = np.flatnonzero(keep)
    if not len(places):
        return places, np.empty(0, dtype=f"S{8 * WINDOW}")
    at = places[:, None] + np.arange(WINDOW)
    words = np.where(at < ends[places][:, None], ids[np.minimum(at, len(ids) - 1)], np.uint64(0))
    keys = _rows(words)
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def shard_matches(ids: np.ndarray, begin: np.ndarray, index: dict) -> list[list[tuple[str, int, int, int]]]:
    """For each text of a shard, its maximal verbatim matches as (item, item word, text word, words)."""
    n = len(begin) - 1
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in range(n)]
    doc = np.repeat(np.arange(n), np.diff(begin))
    if not len(ids) or not len(index["sizes"]):
        return out
    places, keys = suffix_array(ids, begin[1:][doc], index["openings"])
    lo, hi = np.searchsorted(keys, index["low"], "left"), np.searchsorted(keys, index["high"], "right")
    window, rank = _spread(lo, hi - lo)
    at = places[rank]
    # each occurrence of a window stands for all (item, place) that have it
    hit, place = _spread(index["first"][window], np.diff(index["first"])[window])
    item, start = index["places"][place].T
    at, size = at[hit], index["sizes"][window[hit]]
    owner = doc[at] if len(at) else at
    diagonal = at - start
    order = np.lexsort((at, diagonal, item, owner))
    item, start, at, size, owner, diagonal = (x[order] for x in (item, start, at, size, owner, diagonal))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1
    for h, t in zip(head.tolist(), tail.tolist()):
        o = int(owner[h])
        out[o].append((index["names"][item[h]], int(start[h]), int(at[h] - begin[o]), int(at[t] - at[h] + size[t])))
    return out


def _summary(n_words: int, matches: list[tuple[str, int, int, int]]) -> dict:
    hit, reach = 0, 0
    for _, _, at, size in sorted(matches, key=lambda m: (m[2], -m[3])):
        hit += max(0, at + size - max(at, reach))
        reach = max(reach, at + size)
    items = sorted({m[0] for m in matches})
    return {
        "n_words": n_words,
        "n_hit": hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
        "contaminated": hit > 0,
        "longest": max((m[3] for m in matches), default=0),
        "matches": [dict(zip(("item", "item_word", "doc_word", "n_words"), m)) for m in matches],
    }


def _search(index, text: str, earlier: bool, out: str):
    """The function for mapInArrow that searches one block of the benchmark; ``earlier``: rows carry other blocks' matches."""
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64()), ("matches", pa.list_(_MATCH))])

    def run(batches):
        hasher = _Hasher()
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
            before = batch.column(batch.schema.get_field_index(out)).to_pylist() if earlier else None
            found, at = [], 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES, "right")) - 1)
                own = offsets[at : to + 1] - offsets[at]
                ids, begin = hasher.words(data[offsets[at] : offsets[to]], own)
                for k, matches in enumerate(shard_matches(ids, begin, index.value)):
                    if earlier:
                        matches = [tuple(m.values()) for m in before[at + k]["matches"]] + matches
                    found.append(_summary(int(begin[k + 1] - begin[k]), matches))
                at = to
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(found, type=kind)], names=names + [out])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """Adds the struct ``out`` to every row of ``docs``: words, hit words, items, and all maximal verbatim matches.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is 10 consecutive words
    of an item (all its words, if fewer). Rows of an item_id are one item; a null item_id is written as an empty string;
    null and wordless texts have no words and no window. Rows of ``docs`` stay as they are, repeated ones too; a column
    named as ``out`` is replaced. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    out_docs = docs.drop(out)
    for b in range(blocks):
        # a block is bounded by BLOCK_CHARS and one item; rows of an item share their block
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        index = spark.sparkContext.broadcast(benchmark_index([(r["item"], r["text"]) for r in block]))
        schema = T.StructType([f for f in out_docs.schema.fields if f.name != out] + [T.StructField(out, SUMMARY)])
        out_docs = out_docs.mapInArrow(_search(index, text, b > 0, out), schema)
    return out_docs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of which no word is hit, with the columns of ``docs``."""
    return contamination(docs, benchmark, out="_tidemark_contamination").where(~F.col("_tidemark_contamination.contaminated")).drop("_tidemark_contamination")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", *[f"contamination.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


ORACLE = r"""
with item_words as (
  select coalesce(cast(item_id as varchar), '') item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
sized as (select item, w, least(10, len(w)) k from item_words where len(w) > 0),
windows as (
  select distinct item, k, array_to_string(w[p:p + k - 1], ' ') win
  from (select item, w, k, unnest(range(1, len(w) - k + 2)) p from sized)),
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
grams as (
  select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) p from doc_words, (select distinct k from windows))),
hits as (select distinct doc_id, item, k, p from grams join windows using (k, win)),
hit_words as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + k)) q from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc_words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
