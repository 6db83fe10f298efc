"""Conversation prefix trie: nodes are distinct sequences of first turns, found by chained digests of the prefixes.

A prefix's digest is the SHA-256 of the digest before it and its last turn's, so equal digests at a depth are equal
sequences; every prefix of every conversation is a row, and grouping by (depth, digest) gives the nodes. Each node then
goes to all its ancestors, whose sums are those of their subtrees.

Both would grow with the square of a conversation's length if it were taken whole. Turns are held in blocks of BLOCK
depths: digests are chained inside a block and continue those of the blocks before it, whose ends are chained in the
same way; nodes go to their ancestors inside the block, and the totals of the blocks below hang on the last of them. So
no row or task holds more than a block of a conversation, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, join_by_weight, prefix_sum, table

BLOCK = 64
#: Conversations c to c + 99 begin with turns of c, at most FAMILY_TURNS - 1 of them.
FAMILY = 100
FAMILY_TURNS = 6
#: Own turns of a conversation are joined with what they need to know of it in pieces of so many.
PIECE = 4096
#: Ids that end at a node are joined to text by ranges of so many ids.
RANGE_BITS = 12
_START = hashlib.sha256(b"").digest()
_NOTHING = hashlib.sha256(b"").hexdigest()


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, item, size): turns with their place from 1, the digest of (role, text) and the text's code points.

    Turns go by number, null first; those with one number go by digest. A null role or text is empty. Turns without
    conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    item = _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", item.alias("item"), F.length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    return prefix_sum(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("item").asc_nulls_first()], "one", "before").select("conv_id", (F.col("before") + 1).alias("pos"), "item", "size")


def rebuilt(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, i, item, size) of the rebuilt conversations, i from 1, and (conv_id, length) of them all.

    The first h turns come from the conversation c - c % 100, h being crc32 of the decimal id modulo 6 (fewer, if it has
    fewer), the rest are the own turns beyond the first h.
    """
    counts = checkpointed(items.groupBy("conv_id").agg(F.count("*").alias("turns")))
    take = F.crc32(F.col("conv_id").cast("string").cast("binary")) % FAMILY_TURNS
    convs = counts.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), take.alias("take"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("turns").alias("there")), "base", "left")
    convs = convs.withColumn("head", F.least("take", F.coalesce("there", F.lit(0))))
    convs = checkpointed(convs.withColumn("length", F.col("head") + F.greatest(F.col("turns") - F.col("take"), F.lit(0))))
    heads = items.where(F.col("pos") < FAMILY_TURNS).select(F.col("conv_id").alias("base"), F.col("pos").alias("i"), "item", "size")
    heads = convs.select("conv_id", "base", "take").join(heads, "base").where("i <= take").select("conv_id", "i", "item", "size")
    # the turns of a long conversation meet its row in pieces
    pieces = convs.select("conv_id", "take", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("turns") / PIECE))).alias("piece"))
    own = items.withColumn("piece", F.floor(F.col("pos") / PIECE)).join(pieces, ["conv_id", "piece"]).where("pos > take")
    own = own.select("conv_id", (F.col("pos") - F.col("take") + F.col("head")).alias("i"), "item", "size")
    return heads.union(own), convs.select("conv_id", "length")


def _chained(items: Column) -> Column:
    """Digests of the prefixes of an array of (i, item, ...)."""
    digest = lambda done, x: _sha(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(_START)), x["item"]))
    return F.aggregate(items, F.array().cast("array<binary>"), lambda done, x: F.concat(done, F.array(digest(done, x))))


def paths(items: DataFrame) -> DataFrame:
    """(conv_id, block, path, sizes, up): the prefix digests of ``items`` (conv_id, i from 0, item, size) by blocks.

    ``up`` is the digest before the block's first, null for block 0.
    """
    blocks = items.groupBy("conv_id", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "item", "size"))).alias("items"))
    blocks = checkpointed(blocks.select("conv_id", "block", _chained(F.col("items")).alias("path"), F.col("items.size").alias("sizes")))
    if not (blocks.agg(F.max("block")).first()[0] or 0):
        return blocks.withColumn("up", F.lit(None).cast("binary"))
    ends = paths(blocks.select("conv_id", F.col("block").alias("i"), F.element_at("path", -1).alias("item"), F.lit(0).cast("long").alias("size")))
    up = ends.select("conv_id", (F.col("block") * BLOCK + 1).alias("first"), F.posexplode("path").alias("k", "up")).select("conv_id", (F.col("first") + F.col("k")).alias("block"), "up")
    joined = blocks.join(up.withColumnRenamed("up", "_up"), ["conv_id", "block"], "left")
    # a later block goes on from the blocks before it; its own first digest's parent is the last of the block before
    full = joined.withColumn("path", F.when(F.col("_up").isNull(), F.col("path")).otherwise(F.transform("path", lambda x: _sha(F.concat(F.col("_up"), x)))))
    full = checkpointed(full.drop("_up"))
    last = full.select("conv_id", (F.col("block") + 1).alias("block"), F.element_at("path", -1).alias("up"))
    return checkpointed(full.join(last, ["conv_id", "block"], "left"))


def subtree_sums(nodes: DataFrame, blocks: DataFrame, values: list[str]) -> DataFrame:
    """(digest, *values): for each of ``nodes`` (digest, conv_id, i, *values) the sums over its subtree, itself included.

    ``blocks`` (conv_id, block, path) has the path to node i of conversation conv_id, which passes through the node.
    """
    sums = [F.sum(v).alias(v) for v in values]
    reach = blocks.select("conv_id", "block", "path")
    inside = nodes.withColumn("block", F.floor(F.col("i") / BLOCK)).join(reach, ["conv_id", "block"])
    chain = F.slice("path", 1, (F.col("i") % BLOCK + 1).cast("int"))
    own = checkpointed(inside.select(F.explode(chain).alias("digest"), *values).groupBy("digest").agg(*sums))
    if (nodes.agg(F.max("i")).first()[0] or 0) < BLOCK:
        return own
    # the first nodes of all blocks are a tree of their own, with the sums of their blocks
    entries = nodes.where(F.col("i") % BLOCK == 0).select("digest", "conv_id", F.floor(F.col("i") / BLOCK).alias("i")).join(own, "digest")
    entries = checkpointed(entries)
    upper = blocks.select("conv_id", F.col("block").alias("i"), F.element_at("path", 1).alias("first"))
    upper = upper.groupBy("conv_id", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "first")))["first"].alias("path"))
    totals = subtree_sums(entries, checkpointed(upper), values)
    # they count for all nodes of the block above that they hang on
    hanging = entries.where("i > 0").select("digest", "conv_id", (F.col("i") - 1).alias("block")).join(totals, "digest").drop("digest").join(reach, ["conv_id", "block"])
    below = hanging.select(F.explode("path").alias("digest"), *values)
    return own.union(below).groupBy("digest").agg(*sums)


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of comma-joined texts, a piece at a time; the pieces of a digest come one after another."""
    at, running, done = None, None, []
    for batch in batches:
        for digest, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != at:
                if running:
                    done.append((at, running.hexdigest()))
                at, running = digest, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["digest", "ends_sha256"])
        done = []
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()])], names=["digest", "ends_sha256"])


def id_hashes(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the SHA-256 of the ids (digest, conv_id) of each digest, ascending and comma-joined.

    Ids are joined by ranges in all tasks; a hash is of one sequence, so the task of its digest reads its ranges in
    order, and holds one of them at a time.
    """
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("digest", F.shiftright("conv_id", RANGE_BITS).alias("at")).agg(texts.alias("ids"))
    return pieces.repartition("digest").sortWithinPartitions("digest", "at").select("digest", "ids").mapInArrow(_joined_hashes, "digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text); other columns are left out.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Odd rows: see ``numbered`` and ``rebuilt``; a conversation without turns after being
    rebuilt ends at the root. Repeated rows are repeated turns. An empty table gives no rows.
    """
    items, convs = rebuilt(numbered(turns))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit(_START).alias("item"), F.lit(0).cast("long").alias("size"))
    blocks = paths(root.union(items))
    above = F.concat(F.array("up"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    each = F.posexplode(F.arrays_zip("path", "sizes", above.alias("above")))
    prefixes = blocks.select("conv_id", "block", each.alias("k", "x")).select("conv_id", (F.col("block") * BLOCK + F.col("k")).alias("i"), F.col("x.path").alias("digest"), F.col("x.above").alias("parent"), F.col("x.sizes").alias("size"))
    # a node's parent and last text are the same for all its members
    nodes = prefixes.groupBy("i", "digest", "parent", "size").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = checkpointed(nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").na.fill(0, ["n_children"])
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")}
    nodes = checkpointed(nodes.withColumns(values))
    sums = subtree_sums(nodes.select("digest", "conv_id", "i", *values), blocks, list(values))
    last = convs.withColumn("block", F.floor(F.col("length") / BLOCK)).join(blocks, ["conv_id", "block"])
    ends = id_hashes(last.select(F.element_at("path", (F.col("length") % BLOCK + 1).cast("int")).alias("digest"), "conv_id"))
    whole = checkpointed(nodes.drop(*values).join(sums, "digest").join(ends, "digest", "left"))
    parents = whole.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = join_by_weight(whole.where("parent is not null"), parents, "parent", "n_children")
    named = named.select(*whole.columns, "parent_conv_id").union(whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return named.select("conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
with bits as (select i, list_reduce([i] || range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) crc from (select unnest(range(256)) i)),
crcs as (select list(crc order by i) t from bits),
turns as (
  select conv_id, coalesce(role, '') || chr(0) || coalesce(text, '') item, length(coalesce(text, '')) size,
         row_number() over (partition by conv_id order by turn nulls first, sha256(cast(octet_length(encode(coalesce(role, ''))) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))) pos
  from conversations where conv_id is not null),
ids as (select conv_id, conv_id - conv_id % 100 base, cast(conv_id as varchar) s from (select distinct conv_id from turns)),
hashed as (
  select conv_id, base, xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda k: cast(unicode(s[k]) as bigint)),
                                        lambda c, b: xor(t[cast(xor(c, b) & 255 as int) + 1], c >> 8)), 4294967295) % 6 h
  from ids, crcs),
joined as (
  select h.conv_id, 0 own, t.pos, t.item, t.size from hashed h join turns t on t.conv_id = h.base and t.pos <= h.h
  union all select h.conv_id, 1, t.pos, t.item, t.size from hashed h join turns t on t.conv_id = h.conv_id and t.pos > h.h),
whole as (
  select hashed.conv_id, coalesce(list(item order by own, pos) filter (item is not null), []) items, coalesce(list(size order by own, pos) filter (item is not null), []) sizes
  from hashed left join joined on hashed.conv_id = joined.conv_id group by hashed.conv_id),
prefixes as (select conv_id, d, items[1:d] p, case when d > 0 then items[1:d - 1] end up, case when d > 0 then sizes[d] else 0 end size, len(items) = d last from (select *, unnest(range(len(items) + 1)) d from whole)),
nodes as (
  select d, p, any_value(up) up, any_value(size) size, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '')) ends_sha256
  from prefixes group by d, p),
children as (select up p, count(*) n from nodes where up is not null group by up),
weighed as (select nodes.*, coalesce(n, 0) n_children from nodes left join children on nodes.p = children.p),
sums as (
  select above p, sum(case when n_children = 0 then 1 else 0 end) n_leaves, sum((n_convs - 1) * size) saved_tokens
  from (select n_children, n_convs, size, p[1:unnest(range(d + 1))] above from weighed) group by above)
select w.conv_id, d depth, parent.conv_id parent_conv_id, w.n_convs, cast(w.n_children as bigint) n_children, cast(n_leaves as bigint) n_leaves, cast(saved_tokens as bigint) saved_tokens, w.ends_sha256
from weighed w join sums on w.p = sums.p left join (select p, conv_id from nodes) parent on w.up = parent.p
"""
