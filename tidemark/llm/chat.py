"""Chat formatting: a dialogue rendered once for every participant.

In a participant's rendering their turns are the assistant's and are trained on; all others are named users; narrators
(system turns) stay as they are in every rendering and are nobody's view. A rendering stays a row per turn, with the
turn's place in the rendered dialogue, so that a dialogue of any length needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_sum, table

NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), F.col("body").asc_nulls_last()]


def _unmarked(s: Column) -> Column:
    """Breaks up marks, so that no text or role opens or closes a turn."""
    return F.replace(s, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """A row per perspective and turn of ``turns`` (conv_id, turn, role, text); other columns are left out.

    Columns: conv_id, perspective, turn, speaker, as_role, segment, start, mask_start, mask_end. ``start`` is the
    segment's first character in the rendered dialogue, segments being joined in order of turn; the mask spans the text
    and end mark of the perspective's own turns, and is null elsewhere. A null role is a participant named "unknown"; a
    null text is empty; turns without number come last; turns with one number go by speaker and text. Marks in a text
    or role are broken up, and line ends in a role's name become spaces. An empty table gives no rows; a dialogue of any
    length is spread over tasks; repeated rows are repeated turns. A dialogue of narrators alone has no perspective.
    """
    marked = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), _unmarked(F.coalesce("text", F.lit(""))).alias("body"))
    views = marked.where(~F.col("speaker").isin(*NARRATORS)).groupBy("conv_id", "speaker").agg(F.lit(1).alias("_one")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    as_role = F.when(F.col("speaker").isin(*NARRATORS), F.col("speaker")).when(own, "assistant").otherwise("user")
    name = F.when(F.col("as_role") == "user", F.concat(F.lit(" name="), _unmarked(F.regexp_replace("speaker", r"[\r\n]", " ")))).otherwise("")
    head = F.concat(F.lit(OPEN), "as_role", name, F.lit("\n"))
    rows = marked.join(views, marked.conv_id.eqNullSafe(views["_conv"])).drop("_conv").withColumn("as_role", as_role)
    rows = rows.withColumn("_head", F.length(head).cast("long")).withColumn("segment", F.concat(head, "body", F.lit(CLOSE + "\n"))).withColumn("_size", F.length("segment").cast("long"))
    at = prefix_sum(rows, ["conv_id", "perspective"], _order(), "_size", "start")
    train = F.col("as_role") == "assistant"
    return at.select(
        "conv_id", "perspective", "turn", "speaker", "as_role", "segment", "start",
        F.when(train, F.col("start") + F.col("_head")).alias("mask_start"),
        F.when(train, F.col("start") + F.col("_size") - 1).alias("mask_end"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = r"""
with marked as (select conv_id, turn, coalesce(role, 'unknown') speaker, replace(coalesce(text, ''), '<|', '< |') body from conversations),
views as (select distinct conv_id, speaker perspective from marked where speaker <> 'system'),
played as (
  select m.*, v.perspective, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as_role
  from marked m join views v on m.conv_id is not distinct from v.conv_id),
headed as (select *, '<|im_start|>' || as_role || case when as_role = 'user' then ' name=' || replace(replace(replace(speaker, chr(10), ' '), chr(13), ' '), '<|', '< |') else '' end || chr(10) head from played),
segments as (select *, head || body || '<|im_end|>' || chr(10) segment from headed),
placed as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls last, speaker, body
                                                rows between unbounded preceding and 1 preceding), 0) start
  from segments)
select conv_id, perspective, turn, speaker, as_role, segment, cast(start as bigint) "start",
       cast(case when as_role = 'assistant' then start + length(head) end as bigint) mask_start,
       cast(case when as_role = 'assistant' then start + length(segment) - 1 end as bigint) mask_end
from placed
"""
