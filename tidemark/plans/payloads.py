"""Payloads and documents of several shapes, written from the given tables, and what is read back from them."""

from pyspark.sql import functions as F

from tidemark.functions import payloads
from tidemark.plans.register import registry
from tidemark.sources.views import table

query, QUERIES, ORACLES = registry()
#: The same event in three shapes of schedule, nested in different ways; k is a number of the row's props.
SHAPES = (
    '{"meta": {"unlocks": null, "releaseSchedule": [0]}, "data": {"Release_Schedule": [{"date": "2024-01-15", "allocations": [{"allocationName": "Core Team", "unlockAmount": %k}, {"label": "ICO", "amount": "7.5"}]}]}}',
    '[{"x": [1, {"y": null}]}, {"deep": {"unlocks": {"unlock_date": "16/01/2024", "allocation_details": {"Seed sale": %k, "Rewards": "nan"}}}}]',
    '{"ReleaseCalendar": [{"eventDate": 1705276800, "name": "Grants", "percentage": "%k%"}, {"label": "no date", "tokens": 1}], "total_supply": "1000"}',
)


def _shaped(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1)
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("event_id") % 3 + 1).cast("int"))
    wrapped = F.replace(F.replace(shape, F.lit("%k%"), F.concat(k, F.lit("%"))), F.lit("%k"), k)
    return table(spark, sf, "events").select("event_id", wrapped.alias("payload"))


K = "cast(json_extract(props, '$.k') as double)"


@query(f"""with e as (select event_id, {K} k from events),
  x as (
    select event_id, date '2024-01-15' event_date, 'Core Team' raw_label, 'Team/Founders' bucket, k tokens from e where event_id % 3 = 0 and k > 0
    union all select event_id, date '2024-01-15', 'ICO', 'Airdrop/Public', 7.5 from e where event_id % 3 = 0
    union all select event_id, date '2024-01-16', 'Seed sale', 'VC/Investors', k from e where event_id % 3 = 1
    union all select event_id, date '2024-01-15', 'Grants', 'Ecosystem', round(case when k > 1 then k / 100 else k end * 1000, 6) from e where event_id % 3 = 2)
  select * from x""")
def schedule_rows(spark, sf):
    """Events of the first schedule that a payload holds, wherever it is."""
    df = _shaped(spark, sf).select("event_id", payloads.json_find_first(F.col("payload"), payloads.SCHEDULES).alias("s"), payloads.json_find_first(F.col("payload"), payloads.METRICS["total_supply"]).try_cast("double").alias("supply"))
    rows = df.select("event_id", F.inline(payloads.schedule_events(F.col("s"), F.col("supply"))))
    return rows.withColumn("tokens", F.round("tokens", 6))


@query("""select event_id, case event_id % 3 when 0 then 2 when 1 then 0 else 1 end n_lists, case event_id % 3 when 0 then '[0]' when 2 then '[{"eventDate": 1705276800, "name": "Grants", "percentage": "' || json_extract(props, '$.k') || '%"}, {"label": "no date", "tokens": 1}]' end first_list from events""")
def payload_lists(spark, sf):
    """All lists under a schedule's names, in the order in which they stand."""
    lists = payloads.json_collect_lists(F.col("payload"), payloads.SCHEDULES).alias("lists")
    return _shaped(spark, sf).select("event_id", lists).select("event_id", F.size("lists").alias("n_lists"), F.get("lists", F.lit(0)).alias("first_list"))


@query(f"""select event_id, sha256('{{"a":[1,2],"k":' || json_extract(props, '$.k') || '}}') payload_hash from events""")
def payload_hash(spark, sf):
    """The hash of a payload's canonical form: sorted keys, no spaces."""
    payload = F.concat(F.lit('{"k" : '), F.regexp_extract("props", r"(\d+)", 1), F.lit(', "a": [1,  2]}'))
    return table(spark, sf, "events").select("event_id", F.sha2(payloads.canonical_json(payload), 256).alias("payload_hash"))


#: A schedule of two rows as a page, a file, an object and a text; s is a supplier's number.
DOCUMENTS = {
    "text/html": "<h1>Vesting</h1><table><tr><th> Unlock Date </th><th>Allocation</th><th>Token Amount</th></tr><tr><td>2024-03-0%d</td><td>Team %s</td><td>1,%s00</td></tr><tr><td></td><td></td><td></td></tr><tr><td>2024-04-01</td><td>Seed sale</td><td>50</td></tr><tr><td>short</td></tr></table>",
    "text/csv": 'Unlock Date,Allocation,Token Amount\r\n2024-03-0%d,Team %s,"1,%s00"\r\n2024-04-01,Seed sale,50\r\nnever,Seed sale,9\r\n',
    "application/json": '{"rows": [{"date": "2024-03-0%d", "allocation": "Team %s", "amount": 1%s00}, {"note": {"unlock_date": "2024-04-01", "bucket": "Seed sale", "pct": "5%", "max_supply": "1000"}}]}',
    "text/plain": "Schedule. On 2024-03-0%d unlock of Team %c: 1,%s00 tokens.\n2024-04-01 - Seed sale 50",
}


def _documents(spark, sf):
    """A document per supplier and kind; every kind says the same, a text with a letter for the number in the label."""
    s = (F.col("s_suppkey") % 90 + 10).cast("string")
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("mime"), F.lit(b).alias("body")) for m, b in DOCUMENTS.items()]))
    df = table(spark, sf, "supplier").select("s_suppkey", s.alias("s"), kinds.alias("x")).select("s_suppkey", "s", "x.*")
    day, letter = (F.col("s_suppkey") % 9 + 1).cast("string"), F.substring(F.lit("abcdefghi"), F.col("s_suppkey").cast("int") % 9 + 1, F.lit(1))
    body = F.replace(F.replace(F.replace(F.col("body"), F.lit("%d"), day), F.lit("%s"), F.col("s")), F.lit("%c"), letter)
    return df.select(F.col("s_suppkey").alias("k"), "mime", body.alias("content"), payloads.document_kind(F.col("mime"), F.lit("https://example.org/x")).alias("kind"))


def _read(spark, sf):
    return _documents(spark, sf).select("k", "mime", "kind", payloads.document_rows(F.col("content"), F.col("kind")).alias("rows"))


@query("""with m as (select unnest(['text/html', 'text/csv', 'application/json', 'text/plain']) mime), s as (select s_suppkey k, s_suppkey % 90 + 10 s, s_suppkey % 9 + 1 d from supplier),
  x as (select k, mime, cast('2024-03-0' || d as date) event_date, case when mime = 'text/plain' then 'unlock of Team ' || 'abcdefghi'[d] else 'Team ' || s end raw_label, 'Team/Founders' bucket, cast('1' || s || '00' as double) tokens from s, m
    union all select k, mime, date '2024-04-01', 'Seed sale', 'VC/Investors', 50.0 from s, m)
  select * from x where event_date > date '2024-03-03'""")
def document_events(spark, sf):
    """Events after a day from pages, files, objects and texts, each read by its own header."""
    rows = _read(spark, sf).select("k", "mime", F.inline(payloads.row_events(F.col("rows"))))
    return rows.where(F.col("event_date") > F.lit("2024-03-03").cast("date")).withColumns({"raw_label": F.trim("raw_label"), "tokens": F.round("tokens", 6)})


@query("""with s as (select s_suppkey k, s_suppkey % 90 + 10 s, s_suppkey % 9 + 1 d from supplier)
  select k, 'application/json' mime, 'Team ' || s raw_label, cast('1' || s || '00' as double) "value" from s union all select k, 'application/json', 'Seed sale', 0.05 from s
  union all select k, m, 'Team ' || s, cast('1' || s || '00' as double) from s, (values ('text/html'), ('text/csv')) v(m) union all select k, m, 'Seed sale', 0.5 from s, (values ('text/html'), ('text/csv'), ('text/plain')) v(m)
  union all select k, 'text/csv', 'Seed sale', 0.09 * 100 / 1 from s where false union all select k, 'text/csv', 'Seed sale', 0.09 from s
  union all select k, 'text/plain', 'unlock of Team ' || 'abcdefghi'[d], cast('1' || s || '00' as double) from s""")
def document_distribution(spark, sf):
    """Labels and shares of the same documents, dated or not."""
    rows = _read(spark, sf).select("k", "mime", F.inline(payloads.row_distribution(F.col("rows"))))
    return rows.select("k", "mime", F.trim("raw_label").alias("raw_label"), F.round("value", 6).alias("value"))


@query("""with m as (select * from (values ('text/html', 'html', 2), ('text/csv', 'csv', 3), ('application/json', 'json', 2), ('text/plain', 'text', 2)) v(mime, kind, n_rows))
  select s_suppkey k, mime, kind, n_rows::int n_rows, case when kind = 'text' then 0.3 else 1.0 end::double parse_score, case when kind = 'json' then 1000.0 end::double supply_hint from supplier, m""")
def document_scores(spark, sf):
    """What a document was read as, its rows, the score of such rows, and the supply it names."""
    n = F.size("rows")
    score = F.when(F.col("kind") == "text", F.when(n > 0, 0.3).otherwise(0.0)).otherwise(F.when(n > 0, 1.0).otherwise(0.3))
    return _read(spark, sf).select("k", "mime", "kind", n.alias("n_rows"), score.alias("parse_score"), payloads.supply_hint(F.col("rows")).alias("supply_hint"))
