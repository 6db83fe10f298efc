"""Token counts by greedy longest match in linear time.

The vocabulary is a trie. Each node knows where to go on when no longer token matches (its failure link) and how many
whole tokens are finished on that way (its popped count), so that every byte is read once and no piece is ever built.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts are cut before each word, which keeps the one blank before it.
CHUNK = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+?(?= ?[^ \t-\r])|[ \t-\r]+")
CACHE = 1 << 19


class Automaton:
    """Longest-match counter; tokens are byte strings, and every single byte counts as one."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        self.next: dict[int, int] = {}  # node << 8 | byte -> node; node 0 is the root
        ends, parent = [False], [(0, 0)]
        for token in {*tokens, *(bytes([b]) for b in range(256))} - {b""}:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(ends)
                    ends.append(False)
                    parent.append((node, byte))
                node = self.next[key]
            ends[node] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        level = [n for k, n in self.next.items() if k >> 8 == 0]
        children: dict[int, list[int]] = {}
        for key, node in self.next.items():
            children.setdefault(key >> 8, []).append(node)
        while level:  # shorter strings first
            for node in level:
                if ends[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                above, byte = parent[node]
                count, back = self.popped[above], self.fail[above]
                while back << 8 | byte not in self.next:
                    count, back = count + self.popped[back], self.fail[back]
                self.fail[node], self.popped[node] = self.next[back << 8 | byte], count
            level = [c for n in level for c in children.get(n, ())]

    def count(self, data: bytes) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in data:
            while (to := step.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def _counted(automaton, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton.value.count, {}
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes, totals = [], []
            for x in batch.column(at).cast(pa.large_binary()):
                data = x.as_py() or b""
                total = 0
                for m in CHUNK.finditer(data):
                    chunk = m[0]
                    n = known.get(chunk)
                    if n is None:
                        n = count(chunk)
                        if len(chunk) <= 32:
                            if len(known) >= CACHE:
                                known.clear()
                            known[chunk] = n
                    total += n
                sizes.append(len(data))
                totals.append(total)
            rest = [i for i, n in enumerate(batch.schema.names) if n not in (text, out, "n_bytes")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(sizes, type=pa.int64()), pa.array(totals, type=pa.int64())], names=[batch.schema.names[i] for i in rest] + ["n_bytes", out])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``text`` replaced by its bytes (n_bytes) and its tokens (``out``).

    A null text has neither; whole texts are read; repeated rows stay; columns named as a new one are replaced. The
    vocabulary is read where the driver runs and sent to the tasks; it is as large as its file.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    kept = [f for f in docs.schema.fields if f.name not in (text, out, "n_bytes")]
    return docs.mapInArrow(_counted(automaton, text, out), T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.LongType())]))


def op5(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
