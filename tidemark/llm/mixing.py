"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, documents in a hashed order, are packed into blocks of a fixed length. Output shards draw how
many blocks they take from each source (a multinomial draw over the slots of the shard); draws beyond what a source
wants go to sources drawn too seldom, so that totals stay at their targets. The n-th slot that a source gets is mapped through a pseudorandom permutation of the
source's block numbers, a fresh one after each pass over the source, and the blocks join the slots by number. Nothing
but ids, sizes and block numbers is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, prefix_sum, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MOST_PASSES = 3
ROUNDS = 20
SEED = 20240501
CELLS = 1 << 14  # of the line on which slots meet sources


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target) per source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn. They share the total by weight; a target stops at
    MOST_PASSES times the source's size and the rest is shared again, until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sum(sources, [], [F.col("source").asc_nulls_last()], "_one", "rank").drop("_one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    most = F.col("source_size") * MOST_PASSES
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (all_weights or 1), -1
    while True:  # each round stops more sources at their cap; one row comes back
        over = most <= F.col("weight") * F.lit(level)
        n, held, free = ranked.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (held or 0)) / free
    return ranked.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(float(level))))


def _permuted(at: Column, n: Column, key: Column) -> Column:
    """The place of ``at`` in a keyed permutation of 0 .. n-1, by swap-or-not rounds."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        coin = F.xxhash64(key, r, F.greatest(x, partner), F.lit(1)).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), at.cast("long"), swap)


def draws(sources: DataFrame) -> DataFrame:
    """(source, n_blocks, want, shard, n): how many of its slots each shard draws from each source (``targets`` columns).

    Every slot draws on its own, from a keyed hash of its number, a place among the blocks that all sources want; the
    counts of a shard are multinomial with the shares of the sources. Slots meet sources by cells of that line, so that
    neither side is broadcast or held whole, unless Spark finds it small.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    share = sources.where("source_size > 0").withColumn("n_blocks", blocks)
    share = share.withColumn("want", F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long")).where("want > 0")
    share = checkpointed(prefix_sum(share.select("source", "n_blocks", "want"), [], [F.col("source").asc_nulls_last()], "want", "before"))
    total = share.agg(F.sum("want")).first()[0] or 0
    width = total // CELLS + 1
    lines = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("want") - 1) / width))))
    place = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(total, 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), place.alias("place")).withColumn("cell", F.floor(F.col("place") / width))
    met = slots.join(lines, "cell").where("place >= before and place < before + want")
    drawn = met.groupBy("source", "n_blocks", "want", "shard").agg(F.count("*").alias("n"))
    # a source that no slot drew still wants its blocks
    return drawn.unionByName(share.select("source", "n_blocks", "want", F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("n")))


def slots(sources: DataFrame) -> DataFrame:
    """(shard, source, pass, block) for every slot of the mix.

    Draws of a source beyond the blocks it wants go, one for one, to the sources that were drawn too seldom, so that
    each source ends with what it wants; some square root of the draws changes hands.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few rows that stand for many slots: dealt by a fixed number, so that they are not merged into one task
    numbered = checkpointed(prefix_sum(draws(sources), ["source"], [F.col("shard")], "n", "first"))
    kept = numbered.withColumn("kept", F.least("n", F.greatest(F.col("want") - F.col("first"), F.lit(0))))
    own = kept.where("kept > 0").repartition(parts, "source", "shard").select("shard", "source", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("kept") - 1)).alias("slot"))
    over = kept.select("shard", "source", (F.col("n") - F.col("kept")).alias("over")).where("over > 0")
    over = prefix_sum(over, [], [F.col("source").asc_nulls_last(), F.col("shard")], "over", "at")
    over = over.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("over") - 1)).alias("at"))
    lack = numbered.groupBy("source", "n_blocks", "want").agg(F.sum("n").alias("got")).withColumn("lack", F.col("want") - F.col("got")).where("lack > 0")
    lack = prefix_sum(lack, [], [F.col("source").asc_nulls_last()], "lack", "at")
    lack = lack.select("source", "n_blocks", "got", F.posexplode(F.sequence(F.col("at"), F.col("at") + F.col("lack") - 1)).alias("k", "at"))
    each = own.unionByName(over.join(lack, "at").select("shard", "source", "n_blocks", (F.col("got") + F.col("k")).alias("slot")))
    each = each.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks")))
    key = F.xxhash64(F.lit(SEED), "source", "pass")
    return each.select("shard", "source", "pass", _permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), key).alias("block"))


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, start): where the words of every row lie among the words of its source."""
    sizes = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    return prefix_sum(sizes, ["source"], [F.xxhash64("doc_id", "size"), F.col("doc_id"), F.col("size")], "size", "start")


def pieces(at: DataFrame) -> DataFrame:
    """Rows of ``placed`` cut at block edges: adds block, from_word (of the document) and words; empty rows have none."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    cut = at.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest("start", F.col("block") * BLOCK_WORDS)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return cut.select("*", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("words"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: (shard, source, pass, block, doc_id, from_word, words), a row per piece of each block taken."""
    at = placed(docs)
    s, p = slots(targets(at)).alias("s"), pieces(at).alias("p")
    return s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.block") == F.col("p.block"))).select("s.*", "p.doc_id", "p.from_word", "p.words")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``: the words of it that the mix takes.

    A null text has no words; a null source is a source, the last; repeated rows each have a place of their own; an
    empty table gives no rows. No row exceeds MOST_PASSES times its size. Columns of ``docs`` other than the three named
    are not looked at, whatever their names; a text of any length is spread over its blocks.
    """
    at = checkpointed(placed(docs))
    sources = checkpointed(targets(at))
    picked = slots(sources).groupBy("source", "block").agg(F.count("*").alias("times"))
    p, k = pieces(at).alias("p"), picked.alias("k")
    got = p.join(k, F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.block") == F.col("k.block")), "left")
    got = got.groupBy("p.doc_id", "p.source", "p.size", "p.start").agg(F.sum(F.col("p.words") * F.coalesce("k.times", F.lit(0))).alias("taken"))
    rows = got.select("doc_id", "source", "size", "taken").union(at.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long")))
    r, s = rows.alias("r"), sources.alias("s")
    return r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.doc_id", "r.source", "r.size", "s.source_size", "s.target", "r.taken")


def op1(spark, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
