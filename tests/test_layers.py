"""Unlock layers on literal cases."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import layers

DAY = datetime.date(2024, 3, 1)


def market(spark, rows):
    return spark.createDataFrame(rows, "asset string, date date, circ_approx double, total_supply double, market_cap double, avg_30d_volume double")


def at(day, hour=1):
    return datetime.datetime.combine(day, datetime.time(hour))


def event(days, label, tokens):
    return {"date": str(DAY + datetime.timedelta(days)), "label": label, "tokens": tokens}


def test_observed(spark):
    payloads = {
        "ok": {"unlocks": [event(1, "Team", 10), event(30, "ICO", 20), event(31, "Team", 99), event(0, "Team", 99), event(5, "mystery", 5)], "allocation": [{"label": "Team", "share": 30}, {"label": "grants", "share": 60}, {"label": "mystery", "share": 10}]},
        "review": {"unlocks": [event(1, "mystery", 10)], "circulating_supply": 50},
        "empty": {"unlocks": []},
        "odd": {"unlocks": [{"x": 1}], "total_supply": 77},
        "nothing": {},
        "unsupplied": {"unlocks": [event(1, "Team", 10)]},
    }
    rows = [(k, at(DAY), json.dumps(v)) for k, v in payloads.items()] + [("ok", at(DAY, 0), "{}"), ("ok", at(DAY + datetime.timedelta(3)), "not json"), ("nothing", None, "{}")]
    m = market(spark, [("ok", DAY, 100.0, 300.0, 1.0, 1.0), ("unsupplied", DAY, 0.0, None, 1.0, 1.0), ("review", DAY, None, None, 1.0, 1.0)])
    got = {(r.asset, r.date): r for r in layers.observed_layer(spark.createDataFrame(rows, "asset string, at timestamp, payload string"), m).collect()}
    ok = got["ok", DAY]
    assert ok.raw == pytest.approx((1.5 * 10 + 0.6 * 20) / 100) and ok.quality == "ok" and ok.supply == 300 and ok.insider == pytest.approx(1 / 3) and ok.unknown == pytest.approx(5 / 233)
    assert {k[0]: r.quality for k, r in got.items() if k[1] == DAY} == {"ok": "ok", "review": "review_required", "empty": "missing_schedule", "odd": "unparsed_schedule", "nothing": "missing_schedule", "unsupplied": "invalid_circ"}
    assert got["review", DAY].raw is None and got["odd", DAY].supply == 77 and got["ok", DAY + datetime.timedelta(3)].quality == "missing_schedule"


def page(label, tokens, day=10):
    return f"<table><tr><th>date</th><th>category</th><th>tokens</th></tr><tr><td>{DAY + datetime.timedelta(day)}</td><td>{label}</td><td>{tokens}</td></tr></table>"


def test_reconstructed(spark):
    """The latest capture not after the day is read, pages before files of its day; confidence decides what it is good for."""
    before, after = DAY - datetime.timedelta(9), DAY + datetime.timedelta(1)
    captures = [
        ("own", at(before), "text/html", "https://own.org/a", page("Team", 50)),
        ("own", at(before, 5), "text/csv", "https://own.org/a", "date,category,tokens\n"),
        ("own", at(after), "text/html", "https://own.org/a", page("Team", 7777)),
        ("own", at(before - datetime.timedelta(30)), "text/html", "https://own.org/a", page("Team", 8888)),
        ("blog", at(before), "text/html", "https://www.own.substack.com/a", page("Team", 50)),
        ("text", at(before), "text/plain", "https://own.org/a", f"{DAY + datetime.timedelta(10)} Team tokens 50"),
        ("unknown", at(before), "text/html", "https://own.org/a", page("mystery", 50)),
        ("large", at(before), "text/html", "https://own.org/a", page("Team", 50_000)),
        ("broken", at(before), None, None, None),
        ("late", at(after), "text/html", "https://own.org/a", page("Team", 50)),
    ]
    assets = ["own", "blog", "text", "unknown", "large", "broken", "late", "none"]
    m = market(spark, [(a, DAY, 100.0, None, 1.0, 1.0) for a in assets])
    got = {r.asset: r for r in layers.reconstructed_layer(spark.createDataFrame(captures, "asset string, at timestamp, mime string, url string, content string"), m).collect()}
    assert {a: r.quality for a, r in got.items()} == {"own": "ok", "blog": "evidence_only", "text": "evidence_only", "unknown": "review_required", "large": "evidence_only", "broken": "confidence_rejected", "late": "no_capture", "none": "no_capture"}
    assert got["own"].raw == pytest.approx(1.5 * 50 / 100) and all(got[a].raw is None for a in assets[1:])
    assert got["own"].confidence == pytest.approx(0.9) and got["blog"].confidence == pytest.approx(0.8125) and got["large"].confidence == pytest.approx(0.825) and got["none"].confidence is None
    assert got["own"].at == at(before) and got["unknown"].unknown == 1.0


def test_precedence(spark):
    """Each field comes from the first layer that has it."""
    names = ["both", "rebuilt", "market", "review", "nothing"]
    m = market(spark, [("both", DAY, 10.0, 40.0, 100.0, 4.0), ("rebuilt", DAY, 10.0, None, 100.0, 4.0), ("market", DAY, 10.0, 30.0, 100.0, 4.0), ("review", DAY, None, None, 100.0, 4.0), ("nothing", DAY, 10.0, None, None, 4.0)])
    layer = "asset string, date date, raw double, unknown double, insider double, quality string, supply double, at timestamp"
    o = spark.createDataFrame([("both", DAY, 1.0, 0.1, 0.2, "ok", 20.0, at(DAY)), ("review", DAY, None, 0.5, None, "review_required", None, at(DAY))], layer)
    r = spark.createDataFrame([("both", DAY, 2.0, 0.2, 0.9, "ok", 25.0, at(DAY - datetime.timedelta(4)), 0.9), ("rebuilt", DAY, 3.0, 0.0, 0.5, "ok", 25.0, at(DAY - datetime.timedelta(4)), 0.9)], layer + ", confidence double")
    got = {x.asset: x for x in layers.ranked(layers.assemble(m, o, r)).collect()}
    assert [got[a].supply for a in names] == [20.0, 25.0, 30.0, None, None]
    assert [got[a].supply_mode for a in names] == ["observed_supply", "reconstructed_supply", "market_supply", "market_chart_circ_approx", "market_chart_circ_approx"]
    assert [got[a].insider for a in names] == [0.2, 0.5, 0.0, 0.0, 0.0] and [got[a].insider_mode for a in names] == ["observed", "reconstructed", "missing_zeroed", "missing_zeroed", "missing_zeroed"]
    assert [got[a].quality for a in names] == ["ok", "ok", "proxy_full", "review_required", "missing"] and [got[a].source for a in names] == ["observed", "captured", "proxy_full", "observed", None]
    assert [got[a].state for a in names] == ["OBSERVED", "RECONSTRUCTED", "PROXY_FULL", "PROXY_FALLBACK", "MISSING"]
    assert got["both"].unknown == 0.2 and got["rebuilt"].lag_days == 4 and got["both"].raw_proxy_full == pytest.approx(math.log1p(1.0) * 5 * 1.2)
    assert layers.latest_day(m.union(m.withColumn("date", F.date_sub("date", 1)))).count() == 5
    assert layers.ranked(layers.assemble(m.limit(0), o, r)).count() == 0
