"""Prefix tries, filter audits and vector joins against brute force, on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import audit, trie, vectors


# 11 tries


def plain_trie(turns):
    """Nodes of the trie of ``turns`` (conv_id, turn, role, text) by the contract, a sequence at a time."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(rows, key=lambda r: r[0])] for c, rows in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seq = tuple(own.get(base, [])[:h] + rows[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
        ends[seq].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed):
    rng = np.random.default_rng(seed)
    say = lambda: (str(rng.choice(["user", "bot"])), str(rng.choice(["hi", "ho", "ça va", ""])))
    rows = []
    for c in [*range(0, 40), *range(-5, 0), 103, 250, 251, 100, 7_000_000_123]:
        rows += [(c, t, *say()) for t in range(rng.integers(1, 9))]
    rows += [(500, t, "user", "again and again") for t in range(70)] + [(501, t, "user", "again and again") for t in range(61)]
    rows += [(502, None, "user", "unnumbered"), (502, 0, None, "x"), (502, 1, "bot", None), (502, 1, "bot", None), (502, 1, "bot", "tie"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return [tuple(None if x is None else int(x) if k < 2 else str(x) for k, x in enumerate(r)) for r in rows]


@pytest.mark.parametrize("block", [64, 4, 3])
def test_trie(spark, monkeypatch, block):
    """Conversations of more blocks than one, of more blocks of blocks, of negative ids, unnumbered and repeated turns."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIECE", 16)
    monkeypatch.setattr(trie, "RANGE_BITS", 3)
    rows = talks(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("old"), "i": F.lit("old"), "block": F.lit(None).cast("int")})
    got = [tuple(r) for r in trie.prefix_trie(df.repartition(3)).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], df.schema)
    assert trie.prefix_trie(nobody).count() == 0


# 12 filters


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, part in docs:
        s = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", s)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", s)) > 2 * len(s), bool(re.search("[#$%&*|]", s)), i is not None and i > first[s])
        rows.append((part or "", {x for x, f in zip("ABCDE", fails) if f}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, removed, found = [r for r in rows if r[0] == part], defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                left = [r for r in own if not r[1] & set(order[:k])]
                gone = [r for r in left if x in r[1]]
                removed[x] += len(gone)
                redundant = sum(x in r[1] for r in own) - len(gone)
                found.append((part, order, k + 1, len(left) - len(gone), len(gone), redundant, sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), x))
        out += [r[:-1] + (removed[r[-1]],) for r in found]
    return sorted(out)


def test_audit(spark):
    long = " ".join(f"word{k}" for k in range(250))
    texts = [long, long, None, "", "  one two", "Shout " * 300, "pay $5", long + " #tag", "A" * 50, "x\x0by\x1cz " * 150, long.upper(), "é" * 40]
    rows = [(k, t, ["a", "b", None, ""][k % 4]) for k, t in enumerate(texts * 3)]
    rows += [(None, long, "a"), (None, None, "b"), rows[0], rows[0], (1, "another text of id 1", "a"), (-4, texts[5], "only E elsewhere")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(20)] + [(0, 1, 1), (0, None, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"docs": F.lit(7), "fails_A": F.lit("old"), "quality": F.lit(1), "key": F.lit("k")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("old"))
    got = audit.interactions(docs.repartition(3), marks)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    whole = audit.interactions(docs, marks, whole=True).collect()
    assert len(whole) == 600 and sorted(tuple(r)[1:] for r in whole) == [r[1:] for r in plain_audit([(i, t, "") for i, t, _ in rows], labels)]
    assert audit.interactions(docs.limit(0), marks).count() == 0
    assert audit.interactions(docs, marks.limit(0)).agg(F.max("good_lost")).first()[0] == 0


# 13 vectors


def plain_links(rows, limit):
    """(vec_id, n_links, component_id, kept) of all pairs."""
    n = len(rows)
    valid = [v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    near = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if valid[i] and valid[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=float) / max(map(abs, rows[k][1])) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                    near[i].add(j)
                    near[j].add(i)
    out, seen = [], set()
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                todo += (new := near[todo.pop()] - group)
                group |= new
            seen |= group
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            out += [(rows[k][0], len(near[k]), min(ids, default=None), rows[k][0] == min(ids, default=None)) for k in group]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell,limit,dims", [(4096, 0.95, 8), (20, 0.95, 8), (7, 0.95, 3), (5, 0.5, 4), (9, 0.999, 2), (6, 1.0, 3)])
def test_range_join(spark, cell, limit, dims):
    rng = np.random.default_rng(cell)
    base = rng.normal(size=(60, dims))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (3 * base[k] + 0.02 * rng.normal(size=dims)).tolist()) for k in range(30)] + [(200 + k, base[5].tolist()) for k in range(25)]
    rows += [(300 + k, (base[7] * 2.0**k).tolist()) for k in range(4)] + [(None, base[5].tolist()), (None, (base[50] * 1e200).tolist()), (None, None)]
    turn = 0.3
    rows += [(400 + k, [float(np.cos(turn * k)), float(np.sin(turn * k)), *[0.0] * (dims - 2)]) for k in range(12)]  # a chain
    rows += [(500, None), (501, [0.0] * dims), (502, [float("nan")] * dims), (503, [1.0, None, *[0.0] * (dims - 2)]), (504, []), (505, [1.0]), (506, [2.0]), (507, [float("inf")] * dims), (5, base[5].tolist()), (508, [-0.0, 1e-320] + [0.0] * (dims - 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "key": F.lit("old"), "n": F.lit(2)})
    got = vectors.near_vectors(df.repartition(3), limit, cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == [(a, b, c, d) for a, b, c, d in plain_links(rows, limit)]


def test_range_join_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    copies = df.limit(40).select((F.col("vec_id") + 1000).alias("vec_id"), F.transform("embedding", lambda x: x * 2 + 0.01).alias("embedding"))
    both = df.select("vec_id", "embedding").union(copies).union(df.limit(3).select((F.col("vec_id") + 2000).alias("vec_id"), "embedding"))
    rows = [(r.vec_id, r.embedding) for r in both.collect()]
    got = sorted(map(tuple, vectors.near_vectors(both, cell=50).collect()), key=str)
    assert got == plain_links(rows, vectors.LIMIT) and sum(r[1] for r in got) >= 80
    assert vectors.near_vectors(both.limit(0)).count() == 0


def test_visits_leave_room():
    """With pivots that tell clusters apart, vectors visit few cells and still meet all their partners."""
    rng = np.random.default_rng(1)
    centres = np.eye(16)[:12]
    x = np.repeat(centres, 40, axis=0) + 0.02 * rng.normal(size=(480, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = vectors.Cells([c.tobytes() for c in centres], 0.95)
    _, cell, ring = cells.home(128, x)
    counts = Counter(zip(cell.tolist(), ring.tolist()))
    cells.hold([Row(size=128, cell=c, ring=r, n=n) for (c, r), n in counts.items()], 50)
    visits = cells.visits(128, x, cell)
    held, first, last, parts = cells.blocks[128]
    home = [int(np.flatnonzero((held == c) & (first <= r) & (r <= last))[0]) for c, r in zip(cell, ring)]
    assert np.bincount(home).max() <= 50 and (parts == 1).all()
    for i, j in np.argwhere(x @ x.T >= 0.95):
        assert visits[i, home[j]]
    assert visits.sum() < 3 * len(x)
