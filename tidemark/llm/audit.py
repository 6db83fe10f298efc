"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Documents become counts per part and set of failed filters. A cube over the failure flags and the part has a row for
each selection of filters; its rows in which all selected flags are false count the documents that survive the
selection. A filter's effect at a step is the difference of two such rows: the filters before it, and those with it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, table

LETTERS = "ABCDE"
#: Limits of the filters: words, percent of distinct words, percent of capitals, marks.
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 2
MARKS = r"[#$%&*|]"
WHITE = r"[\x20\x09-\x0D]+"
COUNTS = ["docs", "good", "toxic"]


def _flags() -> list[str]:
    return [f"fails_{x}" for x in LETTERS]


def text_failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds fails_A to fails_D, the failures that a text alone decides, and its SHA-256 ``digest``; a null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", F.array_remove(F.split(body, WHITE), ""))
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    return rows.withColumns(
        {
            "fails_A": n < MIN_WORDS,
            "fails_B": 100 * distinct < MIN_DISTINCT * n,
            "fails_C": 100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > MAX_CAPITALS * F.length(body),
            "fails_D": body.rlike(MARKS),
            "digest": F.unhex(F.sha2(body, 256)),
        }
    ).drop("_words")


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, fails_A .. fails_E, docs, good, toxic): documents per part and set of failed filters.

    E fails a row whose doc_id is larger than the smallest of its text. Only the row that holds the smallest is looked
    up, by id and digest together, so a text with a third of the rows is no hot key; equal rows are counted before they
    are dealt. A row without doc_id never fails E, is no copy's original, and has no label. A document is good or toxic
    if any label row of its id says so.
    """
    own = text_failures(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.col(part), F.lit("")).alias("part")))
    keys = ["doc_id", "digest", "part", *_flags()[:4]]
    rows = checkpointed(own.groupBy(*keys).agg(F.count("*").alias("docs")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("key")).where("key is not null").withColumns({"unnamed": F.lit(False), "original": F.lit(True)})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    # rows without an id are dealt by their texts
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.xxhash64("digest")), "unnamed": F.col("doc_id").isNull()})
    rows = rows.join(first, ["key", "unnamed", "digest"], "left").withColumn("fails_E", ~F.col("unnamed") & F.col("original").isNull())
    rows = rows.join(marks.withColumn("unnamed", F.lit(False)), ["key", "unnamed"], "left")
    marked = lambda c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0))
    return rows.groupBy("part", *_flags()).agg(F.sum("docs").alias("docs"), marked("quality").alias("good"), marked("toxic").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, whole, chosen, docs, good, toxic): documents that fail none of the chosen filters (bit k: letter k).

    ``whole`` rows (part null) are over all parts. Selections that nothing survives have no row.
    """
    cube = counts.cube("part", *_flags()).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("_whole"), *[F.grouping(f).alias(f"_not_{f}") for f in _flags()])
    chosen: Column = F.lit(0)
    alive: Column = F.lit(True)
    for k, f in enumerate(_flags()):
        out = F.col(f"_not_{f}") == 1
        chosen = chosen + F.when(out, 0).otherwise(1 << k)
        alive = alive & (out | ~F.col(f))
    return cube.where(alive).select("part", (F.col("_whole") == 1).alias("whole"), chosen.alias("chosen"), *COUNTS)


def steps() -> Column:
    """The 600 steps of the 120 orders: filter_order, step, letter, and the filters chosen before and after it."""
    rows = []
    for order in permutations(LETTERS):
        for k, letter in enumerate(order):
            before = sum(1 << LETTERS.index(x) for x in order[:k])
            fields = {"filter_order": "".join(order), "step": k + 1, "letter": letter, "before": before, "after": before | 1 << LETTERS.index(letter)}
            rows.append(F.struct(*[F.lit(v).alias(n) for n, v in fields.items()]))
    return F.array(*rows)


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source", whole: bool = False) -> DataFrame:
    """A row per part, order of the filters and step, with what the step's filter does there; with ``whole``, of all parts together.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A null
    part is the empty string (with ``whole``, every part is null). Extra columns of either table are left out. An empty
    table of documents gives no rows, empty labels give no losses.
    """
    counts = checkpointed(failure_counts(docs, labels, part))
    alive = survivors(counts).where(F.col("whole") == whole).drop("whole")
    parts = counts.select((F.lit(None).cast("string") if whole else F.col("part")).alias("part")).distinct()
    grid = parts.select("part", F.inline(steps()))

    def of(side: str) -> DataFrame:
        return alive.select(F.col("part").alias(f"_{side}"), F.col("chosen").alias(f"_{side}_set"), *[F.col(c).alias(f"{side}_{c}") for c in COUNTS])

    for side in ("before", "after"):
        grid = grid.join(of(side), F.col("part").eqNullSafe(F.col(f"_{side}")) & (F.col(side) == F.col(f"_{side}_set")), "left").drop(f"_{side}", f"_{side}_set")
    grid = grid.na.fill(0, [f"{side}_{c}" for side in ("before", "after") for c in COUNTS])
    lost = {"removed": "docs", "good_lost": "good", "toxic_lost": "toxic"}
    grid = grid.withColumns({out: F.col(f"before_{c}") - F.col(f"after_{c}") for out, c in lost.items()})
    # the 120 steps of a filter: first it meets all documents, last only those that nothing else removes
    own = Window.partitionBy("part", "letter")
    failing, alone = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(own) for k in (1, len(LETTERS)))
    return grid.select(
        "part", "filter_order", "step", F.col("after_docs").alias("kept"), "removed", (failing - F.col("removed")).alias("redundant"), alone.alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
with marks as (select doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic from labels group by doc_id),
texts as (select doc_id, coalesce(text, '') body, coalesce(source, '') part from documents),
split as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') words, min(doc_id) over (partition by body) first from texts),
flagged as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic, {
    'A': len(words) < 200, 'B': 100 * list_unique(words) < 50 * len(words), 'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body),
    'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(split.doc_id > first, false)} f
  from split left join marks on split.doc_id = marks.doc_id),
docs as (select part, good, toxic, list_filter([case when f.A then 'A' end, case when f.B then 'B' end, case when f.C then 'C' end, case when f.D then 'D' end, case when f.E then 'E' end], lambda x: x is not null) fails from flagged),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (
  select a.x || b.x || c.x || d.x || e.x filter_order from letters a, letters b, letters c, letters d, letters e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
steps as (select filter_order, step, filter_order[step] letter from orders, (select unnest(range(1, 6)) step)),
placed as (
  select part, good, toxic, fails, filter_order, list_min(list_transform(fails, lambda x: instr(filter_order, x))) gone from docs, orders),
counted as (
  select part, filter_order, step, letter, count(*) filter (gone is null or gone > step) kept, count(*) filter (gone = step) removed,
         count(*) filter (list_contains(fails, letter) and gone < step) redundant, count(*) filter (fails = [letter]) unique_fails,
         count(*) filter (gone = step and good) good_lost, count(*) filter (gone = step and toxic) toxic_lost
  from placed join steps using (filter_order) group by part, filter_order, step, letter)
select part, filter_order, cast(step as int) step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) shapley from counted
"""
