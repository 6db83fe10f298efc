"""Toxicity by compression distance.

Zstandard dictionaries are trained on a bounded sample of labelled texts: one on ordinary texts, and one for each of a
few tiers of toxic ones. Windows cover a text but for its white space: runs of letters, of digits or of marks, long runs
in pieces that overlap. A window is compressed with each dictionary between two marks, so that it costs least where one
holds it whole; its gain is its length by the ordinary dictionary less that by a toxic one. How many of a text's
distinct windows gain how much goes through a logistic calibration.

Most of a toxic text is ordinary. The toxic dictionaries are therefore trained on windows that the ordinary one doesn't
hold and that recur: in a few toxic texts for the first tier, in several for the last, and far more often there than in
the ordinary texts. The calibration is cross-fitted: every text of the sample is scored by dictionaries that were
trained on the other folds, whatever the size of the sample. Its intercept is moved so that THRESHOLD lies where recall
less FALSE_COST times the false alarms is largest on those scores.

Sampled near-copies count once, since windows of a much copied text would look like windows that many texts share.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hashed_sample, strings

#: Bounds of the fitting sample: documents of either class, and the pieces in characters into which longer ones are cut.
TOXIC_DOCS, ORDINARY_DOCS, FIT_CHARS = 2000, 5000, 20_000
#: Bytes of a dictionary that the trainer fills, bytes with what it left out, and the lengths of its segments and d-mers.
ORDINARY_BYTES, ORDINARY_MOST, ORDINARY_SEGMENT, ORDINARY_DMER = 2 << 20, 4 << 20, 1024, 8
TOXIC_BYTES, TOXIC_MOST, TOXIC_SEGMENT, TOXIC_DMER = 16 << 10, 64 << 10, 64, 6
#: Texts that must hold a window of each tier of toxic dictionaries, and how much more often toxic ones must.
TIERS = (3, 6)
ODDS = 30
FOLDS = 4
#: Bytes that a window costs at most with a dictionary that holds it whole, and marks on its gain.
HELD = 14
MARKS = (2, 4, 6)
TOP = 3
THRESHOLD = 0.7
FALSE_COST = 5
CACHED_WINDOWS = 1 << 18
#: Characters of a window at most, and from one such window of a run to the next.
RUN, STEP = 32, 16

_RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_EDGE = b"\x01\x02\x03"
_WHOLE = re.compile(re.escape(_EDGE) + rb"([^\x01-\x03]*)" + re.escape(_EDGE[::-1]))
_SECOND = bytes((i + 128) % 256 for i in range(256))


def windows(text: str | None) -> list[str]:
    """The distinct windows of a text in lower case, in their order."""
    out = dict.fromkeys(_RUNS.findall((text or "").lower()))
    if any(len(w) > RUN for w in out):
        out = dict.fromkeys(w[k : k + RUN] for w in out for k in range(0, max(1, len(w) - RUN + STEP), STEP))
    return list(out)


def _marked(window: str) -> bytes:
    return _EDGE + window.encode("utf-8", "replace") + _EDGE[::-1]


def _twice(data: bytes) -> bytes:
    """Each byte and a second form of it: an unmatched letter then costs two bytes, so that one match stands out."""
    out = bytearray(2 * len(data))
    out[::2] = data
    out[1::2] = data.translate(_SECOND)
    return bytes(out)


def _distinct(texts: list[str]) -> list[str]:
    """Texts of which few of the smallest shingle hashes were met before."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = windows(text)
        sketch = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))})[:12]
        if words and sum(h in seen for h in sketch) < max(1, len(sketch) // 6):
            seen.update(sketch)
            out.append(text)
    return out


def _trained(samples: list[str], size: int, segment: int, dmer: int) -> bytes:
    """The content of a dictionary trained on windows; of too few to train on, nothing."""
    try:
        return zstandard.train_dictionary(size, [_marked(w) for w in samples], k=segment, d=dmer, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b""


def _lengths(content: bytes) -> Callable[[str], int]:
    """The compressed length of a window by a dictionary of this content."""
    content = _twice(content)
    bits = max(12, len(content).bit_length())
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False, write_dict_id=False,
        strategy=zstandard.STRATEGY_BTOPT, window_log=min(bits + 1, 27), hash_log=min(bits, 20), chain_log=bits + 1, search_log=6, min_match=3, target_length=64,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress
    return lambda window: len(compress(_twice(_marked(window))))


def _content(samples: list[str], size: int, most: int, segment: int, dmer: int) -> bytes:
    """A trained dictionary before the windows that the trainer cut or left out, the most frequent of which come last."""
    trained, counts = _trained(samples, size, segment, dmer), Counter(samples)
    whole = set(_WHOLE.findall(trained))
    rest, room = [], most - len(trained)
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        marked = _marked(w)
        if marked[len(_EDGE) : -len(_EDGE)] not in whole:
            room -= len(marked)
            if room < 0:
                break
            rest.append(marked)
    return trained + b"".join(reversed(rest)) or b" "


def _dictionaries(bad: list[list[str]], good: list[list[str]]) -> tuple[list[bytes], bytes]:
    """The contents of the toxic dictionaries, one a tier, and of the ordinary one from the windows of texts of either class."""
    ordinary = _content([w for t in good for w in t], ORDINARY_BYTES, ORDINARY_MOST, ORDINARY_SEGMENT, ORDINARY_DMER)
    seen, other = Counter(w for t in bad for w in t), Counter(w for t in good for w in t)
    odd = sorted((w, n) for w, n in seen.items() if n >= TIERS[0] and n * len(good) > ODDS * other[w] * len(bad))
    return [_content([w for w, n in odd if n >= least for _ in range(n)], TOXIC_BYTES, TOXIC_MOST, TOXIC_SEGMENT, TOXIC_DMER) for least in TIERS], ordinary


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, model: dict) -> None:
        self.model = model
        toxic, ordinary = [_lengths(d) for d in model["toxic"]], _lengths(model["ordinary"])

        none = (0,) * len(toxic)

        def gains(w: str) -> tuple[int, ...]:
            first = toxic[0](w)
            if first > HELD:  # the windows of later tiers are in the first
                return none
            usual = ordinary(w)
            return tuple(usual - n if n <= HELD else 0 for n in (first, *(d(w) for d in toxic[1:])))

        self.gains = lru_cache(CACHED_WINDOWS)(gains)

    def features(self, words: list[str]) -> list[float]:
        n = math.log1p(len(words))
        held = [g for g in map(self.gains, words) if g[0]]
        out = [n]
        for tier in range(len(TIERS)):
            gains = sorted((g[tier] for g in held if g[tier]), reverse=True)
            reach = [math.log1p(sum(x >= k for x in gains)) for k in MARKS]
            out += [*(min(max(x, -2), 12) for x in gains[:TOP]), *[0.0] * (TOP - len(gains)), *reach, *(r - n for r in reach)]
        return out

    def score(self, text: str | None) -> float:
        words = windows(text)
        if not words or self.model["weights"] is None:
            return 0.0
        x = (np.array(self.features(words)) - self.model["mean"]) / self.model["scale"]
        return float(1 / (1 + np.exp(-np.clip(x @ self.model["weights"][:-1] + self.model["weights"][-1], -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return w


def _cut(value: np.ndarray, y: np.ndarray) -> float:
    """The value from which on recall less FALSE_COST times the share of false alarms is largest."""
    order = np.argsort(-value, kind="stable")
    hit, wrong = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (1 - y).sum()
    last = np.append(value[order][1:] != value[order][:-1], True)  # rows of one value go together
    return float(value[order][np.argmax(np.where(last, hit - FALSE_COST * wrong, -np.inf))])


def fit_texts(toxic: list[str], ordinary: list[str]) -> dict:
    """A model from texts of either class, in a fixed order."""
    texts = [windows(t) for t in _distinct(toxic)], [windows(t) for t in _distinct(ordinary)]
    empty = {"toxic": [b" "] * len(TIERS), "ordinary": b" ", "weights": None, "mean": 0.0, "scale": 1.0, "key": 0}
    if min(map(len, texts)) < FOLDS:
        return empty
    x, y = [], []
    for f in range(FOLDS):
        content, other = _dictionaries(*[[t for k, t in enumerate(ts) if k % FOLDS != f] for ts in texts])
        scorer = Scorer(empty | {"toxic": content, "ordinary": other})
        for label, ts in zip((1, 0), texts):
            x += [scorer.features(t) for t in ts[f::FOLDS]]
            y += [label] * len(ts[f::FOLDS])
    x, y = np.array(x), np.array(y, dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights = _logistic((x - mean) / scale, y)
    weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) + 1e-9 - _cut(np.c_[(x - mean) / scale, np.ones(len(x))] @ weights, y)
    return empty | dict(zip(("toxic", "ordinary"), _dictionaries(*texts))) | {"mean": mean, "scale": scale, "weights": weights, "key": zlib.crc32(repr((weights, mean, scale)).encode()) or 1}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 modulo 3 (a null id: an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from labelled rows outside the held-out third; a doc_id with several labels is toxic if any is."""
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a text longer than a piece is cut, and its pieces come after the first of all others
    size = F.length("text")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / FIT_CHARS).cast("int")), lambda k: F.struct(k.alias("k"), F.substring("text", k * FIT_CHARS + 1, F.lit(FIT_CHARS)).alias("piece")))
    pieces = docs.select("doc_id", "text").where(size > 0).select("doc_id", F.inline(cuts))
    sample = []
    for kind, most in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS)):
        ids = [r[0] for r in hashed_sample(marks.where(F.col("toxic") == kind), most, "doc_id").select("doc_id").collect()]
        picked = spark.createDataFrame([(i,) for i in ids], marks.select("doc_id").schema)  # at most TOXIC_DOCS or ORDINARY_DOCS ids
        rows = pieces.join(F.broadcast(picked), "doc_id").orderBy("k", F.xxhash64("doc_id"), "doc_id", "piece").limit(most).select("piece").collect()
        sample.append([r[0] for r in rows])
    return fit_texts(*sample)


_HELD: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    """The scorer of a broadcast model; a worker keeps the last, as its index takes seconds to build."""
    if model.value["key"] not in _HELD:
        _HELD.clear()
        _HELD[model.value["key"]] = Scorer(model.value)
    return _HELD[model.value["key"]]


def _scores(model, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            scorer = scorer or _scorer(model)
            found = pa.array([scorer.score(t) for t in strings(column)], type=pa.float64())
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + [found], names=keep + [out])

    return run


def toxicity(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the score of the whole text between 0 and 1; null and wordless texts get 0, other columns stay.

    A column named as ``out`` is replaced. Equal texts have equal scores, and repeated rows stay. A text of any length is
    read whole; its distinct words are held at once. Bytes that are not UTF-8 count as no letters. An empty table gives
    no rows. With fewer than FOLDS different labelled texts of a class every score is 0. The model, at most some 2 MB, is
    broadcast.
    """
    docs = docs.drop(out)
    return docs.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), text, out), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with the columns of ``docs``."""
    return toxicity(docs, fit(docs, labels), out="_tidemark_toxicity").where(F.col("_tidemark_toxicity") < THRESHOLD).drop("_tidemark_toxicity")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
