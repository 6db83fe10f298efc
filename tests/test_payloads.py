"""Payloads and documents of odd shapes against plain recursion and literal cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import payloads


def plain_first(x, keys):
    if isinstance(x, dict):
        for k, v in x.items():
            if k.lower() in keys:
                return v
    inside = x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
    for v in inside:
        if (found := plain_first(v, keys)) is not None:
            return found
    return None


def plain_lists(x, keys):
    out = []
    for k, v in x.items() if isinstance(x, dict) else [("", v) for v in x] if isinstance(x, list) else []:
        out += [v] * (k.lower() in keys and isinstance(v, list)) + plain_lists(v, keys)
    return out


PAYLOADS = [
    {"a": {"b": {"K": 1}}, "k": 2},
    {"a": {"k": None, "b": {"k": 5}}, "c": [{"k": []}, {"k": [1]}]},
    [[{"x": {"k": [[{"k": [2]}]]}}], {"k": "text"}],
    {"j": [3], "k": [{"j": [4, {"k": [5]}]}], "l": {"J": [6]}},
    {}, [], 7, "k", None, {"k": False}, {"a": [{"j": {"k": 0}}]},
]


def test_walks():
    keys = {"k", "j"}
    for x in PAYLOADS:
        assert payloads.find_first(x, keys) == plain_first(x, keys) and payloads.collect_lists(x, keys) == plain_lists(x, keys)
    deep = x = {}
    for _ in range(50_000):
        x["a"] = {}
        x = x["a"]
    x["k"] = 1
    assert payloads.find_first(deep, keys) == 1


def test_columns(spark):
    texts = [json.dumps(x) for x in PAYLOADS] + ["not json", "", None, "[" * 100_000]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "n int, s string")
    got = {r.n: r for r in df.select("n", payloads.json_find_first(F.col("s"), ("k", "j")).alias("f"), payloads.json_collect_lists(F.col("s"), ("k", "j")).alias("l"), payloads.canonical_json(F.col("s")).alias("c")).collect()}
    for k, x in enumerate(PAYLOADS):
        want = plain_first(x, {"k", "j"})
        assert got[k].f == (want if want is None or isinstance(want, str) else json.dumps(want)) and [json.loads(v) for v in got[k].l] == plain_lists(x, {"k", "j"})
        assert got[k].c == (None if x is None else json.dumps(x, sort_keys=True, separators=(",", ":")))
    assert all(got[k].f is None and got[k].l == [] for k in range(len(PAYLOADS), len(texts)))


def events_of(spark, payload, supply=None):
    df = spark.createDataFrame([(payload, supply)], "s string, supply double")
    return [(str(r.event_date), r.raw_label, r.bucket, r.tokens) for r in df.select(F.inline(payloads.schedule_events(F.col("s"), F.col("supply")))).collect()]


def test_schedule(spark):
    row = {"date": "2024-01-15", "allocations": [{"label": "Team", "tokens": "5"}, {"unlockDate": "2025-01-01", "name": "ICO", "amount": 2}, {"label": "none"}, {"label": "neg", "value": -1}]}
    assert events_of(spark, json.dumps([row])) == [("2024-01-15", "Team", "Team/Founders", 5.0), ("2024-01-15", "ICO", "Airdrop/Public", 2.0)]
    assert events_of(spark, json.dumps({"unlock_date": "01/25/2024", "allocation_details": {"seed": "3", "bad": "x"}})) == [("2024-01-25", "seed", "VC/Investors", 3.0)]
    parts = [{"eventDate": "2024-02-01", "bucket": "grants", "percent": p} for p in ("5%", 0.5, 1, "", None)]
    assert [e[3] for e in events_of(spark, json.dumps(parts), 200.0)] == [10.0, 100.0, 200.0] and events_of(spark, json.dumps(parts)) == events_of(spark, json.dumps(parts), 0.0) == []
    for odd in ("[]", "{}", "7", "null", "[1, null, [2]]", "not json", None):
        assert events_of(spark, odd) == []


def test_distribution(spark):
    rows = [{"label": "Team", "share": 20}, {"name": "ICO", "percentage": "0.3"}, {"bucket": "grants", "tokens": 5000}, {"label": "none"}, {"share": 3}]
    df = spark.createDataFrame([(json.dumps(rows),)], "s string")
    assert [tuple(r) for r in df.select(F.inline(payloads.distribution_items(F.col("s")))).collect()] == [("Team", "Team/Founders", 0.2), ("ICO", "Airdrop/Public", 0.3), ("grants", "Ecosystem", 5000.0)]


TABLE = [["Release Date", "Category", "Qty", "Total_Supply", "Share"], ["2024-05-01", "Advisors", "1,000", "5000", ""], ["02/05/2024", "seed", "", "5000", "10%"], ["2024-05-03", "treasury", "", "", "10%"], ["", "x", "1", "", ""], ["2024-05-04", "ICO", "-4", "", ""]]
EVENTS = [(datetime.date(2024, 5, 1), "Advisors", "Team/Founders", 1000.0), (datetime.date(2024, 5, 2), "seed", "VC/Investors", 500.0)]


def shaped(kind):
    if kind == "html":
        cells = "".join("<tr>" + "".join(f"<td> {c} </td>" for c in row) + "</tr>" for row in TABLE)
        return f"<table>{cells}<tr><td>a cell alone</td></tr></table>"
    if kind == "csv":
        return "\n".join(",".join(f'"{c}"' for c in row) for row in TABLE)
    return json.dumps({"a": [dict(zip([h.lower().replace("release date", "date") for h in TABLE[0]], row)) for row in TABLE[1:]]})


@pytest.mark.parametrize("kind", ["html", "csv", "json"])
def test_documents_agree(spark, kind):
    """One schedule in three forms gives the same events, shares and supply."""
    rows = payloads.document_rows(F.col("s"), F.col("k"))
    df = spark.createDataFrame([(shaped(kind), kind)], "s string, k string").select(rows.alias("rows"))
    got = df.select(payloads.row_events(F.col("rows")).alias("e"), payloads.row_distribution(F.col("rows")).alias("d"), payloads.supply_hint(F.col("rows")).alias("h")).first()
    assert [tuple(e) for e in got.e] == EVENTS and got.h == 5000.0
    assert [(d.raw_label, d.value) for d in got.d] == [("seed", 0.1), ("treasury", 0.1)]


def test_text_and_odd_documents(spark):
    cases = [("On 2024-03-01 the Team vesting of 1,200.5 tokens and 05/04/2024: Seed sale 7", "text"), ("nothing here", "text"), ("", "html"), (None, "csv"), ("{", "json"), ("<table><tr><td>only", "html"), (None, "text"), ("%PDF-", "pdf")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "n int, s string, k string").select("n", payloads.document_rows(F.col("s"), F.col("k")).alias("rows"))
    got = {r.n: r.e for r in df.select("n", payloads.row_events(F.col("rows")).alias("e")).collect()}
    assert [(str(e.event_date), e.raw_label.strip(), e.tokens) for e in got[0]] == [("2024-03-01", "the Team vesting of", 1200.5), ("2024-04-05", "Seed sale", 7.0)]
    assert all(not got[k] for k in range(1, len(cases)))


def test_kinds(spark):
    cases = [("application/json", "x", "json"), (None, "https://x/a.CSV", "csv"), ("application/pdf", None, "pdf"), ("text/HTML; charset=utf-8", None, "html"), (None, None, "text"), ("text/plain", "https://x/a.json", "json")]
    df = spark.createDataFrame(cases, "m string, u string, want string")
    assert all(r.want == r.got for r in df.select("want", payloads.document_kind(F.col("m"), F.col("u")).alias("got")).collect())
