"""The bridge's statuses: stream against batch, and literal cases."""

import os
import random

import pyarrow as pa
from pyspark.sql import Row

from tidemark.plans import catalogue
from tidemark.sources.views import bridge_events
from tidemark.streaming import bridge

SF = "/root/testdata/sf0.001"
EVENT = "portfolio string, arrival long, kind string, revision long, fingerprint int, age_days int, expired boolean, instruments array<string>, outcome string"


def event(arrival, kind, revision=None, outcome="submitted", fp=1, portfolio="p", age=1, expired=False, instruments=("A", "B")):
    return (portfolio, arrival, kind, revision, fp, age, expired, list(instruments), outcome)


def plain(rows):
    return sorted((r.portfolio, r.message, r.arrival, r.seq, r.revision, r.status) for r in rows.collect())


def test_stream_equals_batch(spark):
    events = bridge_events(spark, SF)
    batch = plain(bridge.statuses(events, 2400, ("A", "B"), 40))
    assert plain(bridge.replay(events, 2400, ("A", "B"), 40, batches=4)) == batch
    assert {"timeout_waiting_terminal_status", "rejected_superseded", "rejected_duplicate", "rejected_out_of_order", "failed", "noop_band"} <= {r[-1] for r in batch}


CASES = [
    event(1, "retry"),  # nothing is deferred
    event(2, "target", 5, "deferred_not_ready"),
    event(3, "retry", outcome="deferred_not_ready"),
    event(4, "target", 5, fp=1),  # repeated
    event(5, "target", 5, fp=2),  # another portfolio under the same revision
    event(6, "target", 4),  # late
    event(7, "retry", outcome="failed"),  # stays deferred
    event(8, "retry", outcome="submitted"),
    event(9, "retry", outcome="submitted"),  # nothing is deferred any more
    event(10, "target", 6, "deferred_not_ready"),
    event(11, "target", 7, "failed"),
    event(12, "retry"),  # superseded by 7
    event(13, "target", 8, "deferred_not_ready"),  # times out after 20
    event(14, "target", 9, expired=True),
    event(15, "target", 9, instruments=("A",)),
    event(16, "target", 9, "deferred_not_ready"),  # replaces 8, never retried, times out after 23
    event(40, "target", 10, "noop_band", portfolio="q"),
    event(41, "target", 11, "deferred_not_ready", portfolio="q"),  # not due yet
]


def test_cases(spark):
    events = spark.createDataFrame(CASES, EVENT).repartition(2)
    got = plain(bridge.statuses(events, 100, ("A", "B"), 7))
    by = {}
    for portfolio, message, arrival, seq, _, status in sorted(got, key=lambda r: (r[0], r[1], r[3] == 9, r[2], r[3])):
        by.setdefault((portfolio, message), []).append(status)
    assert by["p", 2] == ["received", "accepted", "deferred_not_ready", "deferred_not_ready", "failed", "submitted"]
    assert by["p", 4] == ["received", "rejected_duplicate"] and by["p", 5] == ["received", "rejected_revision_conflict"] and by["p", 6] == ["received", "rejected_out_of_order"]
    assert by["p", 10] == ["received", "accepted", "deferred_not_ready", "rejected_superseded"] and by["p", 11] == ["received", "accepted", "failed"]
    assert by["p", 13] == by["p", 16] == ["received", "accepted", "deferred_not_ready", "timeout_waiting_terminal_status"]
    assert by["p", 14] == ["received", "rejected_stale"] and by["p", 15] == ["received", "rejected_incomplete_snapshot"]
    assert by["q", 41] == ["received", "accepted", "deferred_not_ready"]
    for batches in (1, 3, 6):
        assert plain(bridge.replay(events, 100, ("A", "B"), 7, batches)) == got
    state = {r.portfolio: (r.last_accepted, r.last_applied, r.deferred, r.cursor) for r in bridge.final_state(events, 100, ("A", "B")).collect()}
    assert state == {"p": (9, 5, 9, 16), "q": (11, 10, 11, 41)}
    assert bridge.statuses(events.limit(0), 100, ("A", "B"), 7).count() == 0


def test_message_results(spark):
    cases = {
        "ok": (["received", "accepted", "submitted", "submitted"], True, None),
        "filled": (["accepted", "submitted", "filled"], True, None),
        "rejected": (["received", "rejected_stale", "failed"], False, "rejected_stale"),
        "failed": (["accepted", "failed", "submitted"], False, "failed"),
        "early": (["submitted", "received"], False, "out_of_order_terminal_before_accepted"),
        "unsent": (["accepted", "filled"], False, "out_of_order_filled_before_submitted"),
        "waits": (["received", "accepted", "deferred_not_ready"], False, "timeout_waiting_terminal_status"),
    }
    rows = [(m, k, s) for m, (seen, _, _) in cases.items() for k, s in enumerate(seen)]
    got = {r.message: (r.success, r.reason) for r in bridge.message_results(spark.createDataFrame(rows, "message string, at int, status string"), ["message"], ["at"]).collect()}
    assert got == {m: (ok, reason) for m, (_, ok, reason) in cases.items()}


def test_commits(spark):
    rows = spark.createDataFrame([(s,) for s in ("rejected_stale", "noop_band", "deferred_not_ready", "submitted", "failed", "accepted", "received")], "s string")
    assert [r.c for r in rows.select(bridge.commits(rows.s).alias("c")).collect()] == [True, True, True, True, False, False, False]


class Store:
    """Stands for the state store, counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def __getattr__(self, name):
        answers = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
            "iterator": lambda: iter(list(self.map.items())), "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "containsKey": self.map.__contains__,
        }

        def call(*args):
            self.calls += 1
            return answers[name](*args)

        return call


class Handle:
    def __init__(self):
        self.stores, self.timers = {}, []

    def getValueState(self, name, *schema):
        return self.stores.setdefault(name, Store())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


def test_state_calls_do_not_grow(spark):
    """A batch of a portfolio asks the state store as often for 2,000 events as for 100, but for what still waits."""
    calls = []
    for n in (100, 2000):
        handle, bridge_ = Handle(), bridge.Bridge(40)
        bridge_.init(handle)
        rows = [Row(arrival=k, kind="retry" if k % 5 == 0 else "target", revision=k, fingerprint="1", outcome=("deferred_not_ready", "submitted", "failed")[k % 3], away=None) for k in range(n)]
        list(bridge_.handleInputRows(("p",), iter(rows), None))
        calls.append(sum(s.calls for s in handle.stores.values()) + len(handle.timers))
    assert max(calls) < 60


def test_stream_query(spark):
    assert catalogue.QUERIES["bridge_stream"](spark, SF).count() > 0


def test_events_travel_in_packs(spark):
    """Packs of events give what single ones give, in few rows however many the events are, over batches and portfolios."""
    rnd, outs = random.Random(4), ("deferred_not_ready", "failed", "submitted", "noop_band")
    single, packed = (bridge.Bridge(40), Handle()), (bridge.Bridge(40), Handle())
    for own, handle in (single, packed):
        own.init(handle)
    for batch in range(3):
        rows = [Row(arrival=k, kind=rnd.choice(["retry", "target", "target"]), revision=k // 7 + k * 13 % 5, fingerprint=rnd.choice(["1", "2", None]), outcome=rnd.choice(outs)) for k in range(batch * 2000, batch * 2000 + 2000)]
        rnd.shuffle(rows)
        others = [r.asDict() | {"portfolio": p, "needed": p != "away"} for r in rows for p in ("away", None, "p")]
        packs = [Row(**r) for b in bridge._packed(pa.Table.from_pylist(others, pa.schema([("portfolio", pa.string()), *bridge.EVENT, ("needed", pa.bool_())])).to_batches(2500)) for r in b.to_pylist()]
        assert len(packs) == 9 and max(r.last for r in packs) == batch * 2000 + 1999
        assert not list(packed[0].handleInputRows(("away",), iter([r for r in packs if r.portfolio == "away"]), None))
        got = [list(b.handleInputRows(("p",), iter(r), None)) for (b, _), r in ((single, rows), (packed, [r for r in packs if r.portfolio == "p"]))]
        assert len(got[1]) <= 4
        one, many = ([tuple(map(str, x)) for r in some for x in zip(r.message, r.arrival, r.seq, r.revision, r.status)] for some in got)
        assert one == many and len(many) > 1000
        assert {n: (s.value, s.map) for n, s in single[1].stores.items()} == {n: (s.value, s.map) for n, s in packed[1].stores.items()}


def test_stores_and_odd_rows(spark, monkeypatch, tmp_path):
    """There are no more state stores than cores; missing revisions and prints count as in the batch."""
    rnd, outs = random.Random(5), ("deferred_not_ready", "failed", "submitted", "noop_band")
    rows = []
    for k in range(1, 301):
        kind = rnd.choice(["retry", "target", "target"])
        revision = None if kind == "retry" or rnd.random() < 0.1 else k // 7 + k * 13 % 5
        rows.append(event(k, kind, revision, rnd.choice(outs), rnd.choice([1, 2, None]), rnd.choice("pqr"), rnd.choice([1, 1, 1, 101]), rnd.choice([None, False]), rnd.choice([("A", "B"), ("A", "B"), ("A",)])))
    events = spark.createDataFrame(rows, EVENT)
    monkeypatch.setattr(bridge, "scratch", lambda spark: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        got = plain(bridge.replay(events, 100, ("A", "B"), 7, batches=2))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "12"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert str(got) == str(plain(bridge.statuses(events, 100, ("A", "B"), 7))) and len(got) > 300
    assert len([f for f in os.listdir(tmp_path / "state/state/0") if f.isdigit()]) <= spark.sparkContext.defaultParallelism
