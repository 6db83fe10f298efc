"""Target portfolios on their way to a venue: acceptance, deferral, retries, deadlines and what became of each message.

``statuses`` works the whole history out at once, ``status_stream`` event by event on state; tests hold them equal. Events
are targets (with the outcome that the venue would report) and retries of a deferred target (with theirs), numbered by
arrival and met in that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.prefix import running
from tidemark.sources.folders import checkpointed, scratch
from tidemark.streaming.acceptance import ladder

OUT = "portfolio string, message long, arrival long, seq int, revision long, status string"
#: The same with arrays in place of rows, as they leave the state store's step.
OUTS = "portfolio string, message array<long>, arrival array<long>, seq array<int>, revision array<long>, status array<string>"
#: Events as that step takes them.
EVENT = pa.schema([("arrival", pa.int64()), ("kind", pa.string()), ("revision", pa.int64()), ("fingerprint", pa.string()), ("outcome", pa.string())])
#: Statuses by the ladder's names, and those of a venue.
REJECTED = {"stale": "rejected_stale", "incomplete": "rejected_incomplete_snapshot", "out_of_order": "rejected_out_of_order", "duplicate": "rejected_duplicate", "conflict": "rejected_revision_conflict"}
DEFERRED, FAILED, SUPERSEDED, TIMEOUT = "deferred_not_ready", "failed", "rejected_superseded", "timeout_waiting_terminal_status"
APPLIED = ("submitted", "noop_band")
#: Events that a batch of a replay holds.
PER_BATCH = 2_000_000
#: Statuses that a row out of the state store's step holds at most.
PER_ROW = 10_000


def payload_problems(heads: DataFrame, targets: DataFrame, key: str, now: Column, most: float = 1.0) -> DataFrame:
    """Adds ``problem`` to ``heads`` (key, revision, valid_until): the first rule that a signal breaks, null if none.

    Of its ``targets`` (key, instrument, weight): there are some, each instrument once, no weight is null or below 0, and the
    weights come to ``most``; the signal is valid now, if it says until when; its revision is above 0. Sums are taken before
    the join, so a signal may have any number of targets.
    """
    per = targets.groupBy(key, "instrument").agg(F.count("*").alias("n"), F.sum(F.abs("weight")).alias("gross"), F.count_if(F.coalesce(F.col("weight") < 0, F.lit(True))).alias("bad"))
    one = per.groupBy(key).agg(F.max("n").alias("_most"), F.sum("gross").alias("_gross"), F.sum("bad").alias("_bad"))
    problem = (
        F.when(F.col("_most").isNull(), "empty").when(F.col("_most") > 1, "duplicate_instrument").when(F.col("_bad") > 0, "negative_weight").when(F.col("_gross") > most + 1e-6, "gross")
        .when(F.col("valid_until") < now, "expired").when(~F.coalesce(F.col("revision") > 0, F.lit(False)), "revision")
    )
    return heads.join(one, key, "left").withColumn("problem", problem).drop("_most", "_gross", "_bad")


def commits(status: Column) -> Column:
    """Whether a status moves the cursor past its message: a failure does not."""
    return status.startswith("rejected_") | status.isin(*APPLIED, DEFERRED)


def _judged(events: DataFrame, stale_days: int, managed: tuple[str, ...]) -> DataFrame:
    """Targets with the ladder's ``verdict``."""
    own = events.where("kind = 'target'").drop("kind")
    verdicts = ladder(own, stale_days, managed).select("portfolio", "arrival", F.col("status").alias("verdict"))
    return own.join(verdicts, ["portfolio", "arrival"])


def _retried(judged: DataFrame, events: DataFrame) -> DataFrame:
    """Retries that act on a deferred target: portfolio, message, arrival, revision, status, clears.

    The slot holds the last accepted target that was not a failure, if it was deferred and no earlier retry settled it; a
    target accepted after it, which can only be a failure, makes the retry find it superseded.
    """
    accepted = judged.where("verdict = 'accepted'").select("portfolio", "arrival", "outcome", F.lit(False).alias("retry"))
    both = accepted.union(events.where("kind = 'retry'").select("portfolio", "arrival", "outcome", F.lit(True)))
    settles = F.when(~F.col("retry") & (F.col("outcome") != FAILED), F.col("arrival"))
    fails = F.when(~F.col("retry") & (F.col("outcome") == FAILED), F.col("arrival"))
    both = both.withColumns({"settled": settles, "failure": fails})
    met = running(both, ["portfolio"], [F.col("arrival")], {"message": (F.max, "settled", None), "after": (F.max, "failure", None)}).where("retry")
    slot = judged.where((F.col("verdict") == "accepted") & (F.col("outcome") == DEFERRED)).select("portfolio", F.col("arrival").alias("message"), "revision")
    status = F.when(F.col("after") > F.col("message"), SUPERSEDED).otherwise(F.col("outcome"))
    held = met.join(slot, ["portfolio", "message"]).select("portfolio", "message", "arrival", "revision", status.alias("status"))
    held = held.withColumn("clears", F.col("status").isin(*APPLIED, SUPERSEDED).cast("long"))
    return running(held, ["portfolio", "message"], [F.col("arrival")], {"before": (F.sum, "clears", 0)}).where("before = 0").drop("before")


def statuses(events: DataFrame, stale_days: int, managed: tuple[str, ...], patience: int) -> DataFrame:
    """(portfolio, message, arrival, seq, revision, status): all statuses of all targets, by their message's arrival.

    ``events``: portfolio, arrival, kind (target or retry), revision, fingerprint, age_days, expired, instruments,
    outcome. A target is received, then accepted or rejected, then has its outcome. A retry gives the deferred target's
    outcome. A deferred message without a final status ``patience`` arrivals later has timed out, if any event came
    later than that. Arrivals are numbers, each met once in a portfolio.
    """
    judged = checkpointed(_judged(events, stale_days, managed))
    acts = checkpointed(_retried(judged, events))
    verdict = F.coalesce(*[F.when(F.col("verdict") == k, v) for k, v in REJECTED.items()], F.col("verdict"))
    own = F.col("arrival").alias("message")
    first = judged.select("portfolio", own, "arrival", F.lit(0).alias("seq"), "revision", F.lit("received").alias("status"))
    second = judged.select("portfolio", own, "arrival", F.lit(1), "revision", verdict)
    third = judged.where("verdict = 'accepted'").select("portfolio", own, "arrival", F.lit(2), "revision", "outcome")
    again = acts.select("portfolio", "message", "arrival", F.lit(0), "revision", "status")
    ended = acts.where(F.col("status") != DEFERRED).groupBy("portfolio", "message").agg(F.min("arrival").alias("ended"))
    waits = judged.where((F.col("verdict") == "accepted") & (F.col("outcome") == DEFERRED)).withColumn("message", F.col("arrival"))
    last = events.agg(F.max("arrival").alias("last"))
    late = waits.join(ended, ["portfolio", "message"], "left").join(F.broadcast(last))  # one row
    due = F.col("message") + patience
    late = late.where((F.col("last") > due) & (F.col("ended").isNull() | (F.col("ended") > due))).select("portfolio", "message", "arrival", F.lit(9), "revision", F.lit(TIMEOUT))
    return first.union(second).union(third).union(again).union(late)


def final_state(events: DataFrame, stale_days: int, managed: tuple[str, ...]) -> DataFrame:
    """A row per portfolio: last_accepted and last_applied revision, the deferred one, and the cursor's arrival."""
    judged = checkpointed(_judged(events, stale_days, managed))
    acts = checkpointed(_retried(judged, events))
    accepted = judged.where("verdict = 'accepted'")
    applied = accepted.select("portfolio", "arrival", "revision", F.col("outcome").alias("status")).union(acts.select("portfolio", "arrival", "revision", "status")).where(F.col("status").isin(*APPLIED))
    applied = applied.groupBy("portfolio").agg(F.max_by("revision", "arrival").alias("last_applied"))
    settled = accepted.where(F.col("outcome") != FAILED).groupBy("portfolio").agg(F.max(F.struct("arrival", "revision", "outcome")).alias("s"))
    cleared = acts.where("clears > 0").select("portfolio", "message").distinct()
    held = settled.where(F.col("s.outcome") == DEFERRED).select("portfolio", F.col("s.arrival").alias("message"), F.col("s.revision").alias("deferred"))
    held = held.join(cleared, ["portfolio", "message"], "left_anti").drop("message")
    end = F.when(F.col("verdict") == "accepted", F.col("outcome")).otherwise("rejected_")
    base = judged.groupBy("portfolio").agg(F.max(F.when(F.col("verdict") == "accepted", F.col("revision"))).alias("last_accepted"), F.max(F.when(commits(end), F.col("arrival"))).alias("cursor"))
    return base.join(applied, "portfolio", "left").join(held, "portfolio", "left").select("portfolio", "last_accepted", "last_applied", "deferred", "cursor")


def message_results(rows: DataFrame, message: list[str], order: list[str]) -> DataFrame:
    """(message, success, reason, statuses): what the distinct statuses of each message, in order of their first sight, come to.

    The first rejection or failure decides; then a success without acceptance, or a fill without submission, is out of
    order; then a success succeeds; anything else is still waiting, and so has timed out. Few statuses exist, so what is
    gathered for a message is bounded however often they repeat.
    """
    seen = rows.groupBy(*message, "status").agg(F.min(F.struct(*order)).alias("at"))
    one = seen.groupBy(*message).agg(F.sort_array(F.collect_list(F.struct("at", "status")))["status"].alias("statuses"))
    bad = F.get(F.filter("statuses", lambda s: s.startswith("rejected_") | (s == FAILED)), F.lit(0))
    has = lambda s: F.array_contains("statuses", s)
    good = has("submitted") | has("noop_band") | has("filled")
    reason = (
        F.when(bad.isNotNull(), bad)
        .when(good & ~has("accepted"), "out_of_order_terminal_before_accepted")
        .when(has("filled") & ~has("submitted"), "out_of_order_filled_before_submitted")
        .when(~good, TIMEOUT)
    )
    return one.select(*message, reason.isNull().alias("success"), reason.alias("reason"), "statuses")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per portfolio of an Arrow batch: its ``needed`` events as an Arrow stream, and the ``last`` arrival of them all."""
    for rows in batches:
        if not rows.num_rows:
            continue
        names = rows.column("portfolio").dictionary_encode("encode")
        codes = names.indices.filter(rows.column("needed")).to_numpy(zero_copy_only=False)
        held = rows.select(EVENT.names).filter(rows.column("needed")).take(pa.array(np.argsort(codes, kind="stable")))
        packs, start = [], 0
        for n in np.bincount(codes, minlength=len(names.dictionary)).tolist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as out:
                out.write_batch(held.slice(start, n))
            packs.append(sink.getvalue().to_pybytes())
            start += n
        last = [pc.max(rows.column("arrival")).as_py()] * len(packs)
        yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(last, pa.int64()), pa.array(packs, pa.binary())], ["portfolio", "last", "events"])


def _latest(at: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where ``at`` holds; 0 if none."""
    return np.maximum.accumulate(np.where(at, np.arange(len(at)), 0))


def _among(values: np.ndarray, *some: str) -> np.ndarray:
    return np.logical_or.reduce([values == x for x in some])


class Bridge(StatefulProcessor):
    """State of a portfolio: the last accepted and applied targets, the deferred one, and messages that wait with their deadlines.

    A row holds an event or, as an Arrow stream in ``events``, many. A batch's events of a portfolio are put in order of
    arrival; the source should bound a batch. The state is read once a batch, all its events are met at a time as arrays,
    and what changed is written at the end: a call of the state store costs far more than an event, and so does a row
    that passes between Spark and Python. As many messages wait as arrivals fit a deadline, so they are few. Event time is the arrival in
    seconds, and a deadline is a timer half a second after the last arrival that meets it; a message that is settled or
    late within its own batch needs none.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.values = {
            "accepted": handle.getValueState("accepted", "revision long, fingerprint string"),
            "applied": handle.getValueState("applied", "revision long, arrival long"),
            "slot": handle.getValueState("deferred", "revision long, arrival long"),
        }
        self.kept = handle.getMapState("waiting", "arrival long", "revision long")

    def _load(self, key) -> None:
        (self.portfolio,) = key
        self.before = {name: state.get() if state.exists() else None for name, state in self.values.items()}
        self.now = dict(self.before)
        self.stored = {arrival: revision for (arrival,), (revision,) in self.kept.iterator()}
        self.waiting = dict(self.stored)

    def _save(self) -> None:
        for name, state in self.values.items():
            if self.now[name] != self.before[name]:
                state.clear() if self.now[name] is None else state.update(tuple(self.now[name]))
        for arrival in self.stored.keys() - self.waiting.keys():
            self.kept.removeKey((arrival,))
        for arrival in self.waiting.keys() - self.stored.keys():
            self.kept.updateValue((arrival,), (self.waiting[arrival],))
            self.handle.registerTimer(self._due(arrival))

    def _due(self, arrival: int) -> int:
        return (arrival + self.patience) * 1000 + 500

    def _out(self, message: np.ndarray, arrival: np.ndarray, seq: int, revision: np.ndarray, status: np.ndarray | str) -> Iterator[Row]:
        columns = message, arrival, np.full(len(message), seq, "int32"), revision, np.full(len(message), status, object) if isinstance(status, str) else status
        for k in range(0, len(message), PER_ROW):
            yield Row("portfolio", "message", "arrival", "seq", "revision", "status")(self.portfolio, *[c[k : k + PER_ROW] for c in columns])

    def _judge(self, arrival: np.ndarray, revision: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """The ladder's verdicts on targets after the last accepted one."""
        best, print_ = self.now["accepted"] or (None, None)
        if not len(arrival):
            return np.empty(0, object)
        before = np.maximum.accumulate(np.concatenate(([revision[0] if best is None else best], revision)))[:-1]
        accepted = revision > before
        accepted[0] |= best is None
        held = np.concatenate((np.array([print_], object), fingerprint))[_latest(np.concatenate(([True], accepted)))[1:]]
        if accepted.any():
            top = np.flatnonzero(accepted)[-1]
            self.now["accepted"] = (int(revision[top]), fingerprint[top])
        known = np.where(fingerprint == held, REJECTED["duplicate"], REJECTED["conflict"])
        return np.where(accepted, "accepted", np.where(revision < before, REJECTED["out_of_order"], known)).astype(object)

    def _retried(self, best: int | None, arrival: np.ndarray, retry: np.ndarray, revision: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, ...]:
        """What retries do among accepted targets, in order: message, arrival, revision and status of those that act.

        ``best`` is the revision last accepted before them. A target that is deferred or applied sets the slot; another one
        leaves it as it is, and outdated. A retry acts on the slot until one has emptied it.
        """
        slot = self.now["slot"]
        # two places ahead: the slot as it was, and a target that had outdated it
        retry = np.concatenate(([False, False], retry))
        outcome = np.concatenate((np.array([DEFERRED if slot else APPLIED[0], None], object), outcome))
        revision = np.concatenate(([slot[0] if slot else 0, 0], revision))
        arrival = np.concatenate(([slot[1] if slot else 0, 0], arrival))
        own = ~retry
        own[1] = bool(slot) and slot[0] != best
        setter = _latest(own & _among(outcome, DEFERRED, *APPLIED))
        outdated = _latest(own) > setter
        status = np.where(outdated, SUPERSEDED, outcome)
        tries = retry & (outcome[setter] == DEFERRED)
        clears = tries & _among(status, SUPERSEDED, *APPLIED)
        seen = np.cumsum(clears)
        acts = np.flatnonzero(tries & (seen - clears == seen[setter]))
        last = setter[-1]
        self.now["slot"] = (int(revision[last]), int(arrival[last])) if outcome[last] == DEFERRED and seen[-1] == seen[last] else None
        applied = np.concatenate((np.flatnonzero(own[2:] & _among(outcome[2:], *APPLIED)) + 2, acts[_among(status[acts], *APPLIED)]))
        if len(applied):
            k = setter[applied.max()]
            self.now["applied"] = (int(revision[k]), int(arrival[k]))
        return arrival[setter[acts]], arrival[acts], revision[setter[acts]], status[acts]

    def _wait(self, now: int, message: np.ndarray, revision: np.ndarray, ended: np.ndarray, at: np.ndarray) -> Iterator[Row]:
        """Deferred messages, those of the state and new ones, after what ``ended`` and when, in order: the late are told and let go."""
        held = sorted(self.waiting)
        message, revision = np.concatenate((np.array(held, "int64"), message)), np.concatenate((np.array([self.waiting[m] for m in held], "int64"), revision))
        ends = np.full(len(message), np.iinfo("int64").max)
        if len(message):
            ended, first = np.unique(ended, return_index=True)
            place = np.minimum(np.searchsorted(message, ended), len(message) - 1)
            known = message[place] == ended
            ends[place[known]] = at[first[known]]
        due = message + self.patience
        late, waits = (ends > due) & (due < now), (ends > due) & (due >= now)
        self.waiting = dict(zip(message[waits].tolist(), revision[waits].tolist()))
        yield from self._out(message[late], message[late], 9, revision[late], TIMEOUT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        packs = [pa.ipc.open_stream(r["events"]).read_all() if "events" in r else pa.Table.from_pylist([{c: r[c] for c in EVENT.names}], EVENT) for r in rows]
        events = pa.concat_tables(packs).sort_by("arrival")
        if not events.num_rows:
            return
        arrival, kind, revision, fingerprint, outcome = (events.column(c).to_pandas().to_numpy() for c in EVENT.names)
        retry = kind == "retry"
        self._load(key)
        best = self.now["accepted"] and self.now["accepted"][0]
        verdict = np.full(len(arrival), None, object)
        verdict[~retry] = self._judge(arrival[~retry], revision[~retry], fingerprint[~retry])
        yield from self._out(arrival[~retry], arrival[~retry], 1, revision[~retry], verdict[~retry])
        accepted = verdict == "accepted"
        yield from self._out(arrival[accepted], arrival[accepted], 2, revision[accepted], outcome[accepted])
        on = accepted | retry
        message, at, of, status = self._retried(best, arrival[on], retry[on], revision[on], outcome[on])
        yield from self._out(message, at, 0, of, status)
        defers, ends = accepted & (outcome == DEFERRED), status != DEFERRED
        yield from self._wait(int(arrival[-1]), arrival[defers], revision[defers], message[ends], at[ends])
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        none = np.empty(0, "int64")
        self._load(key)
        yield from self._wait(expiredTimerInfo.getExpiryTimeInMs() // 1000 + 1, none, none, none, none)
        self._save()


def status_stream(source: DataFrame, stale_days: int, managed: tuple[str, ...], patience: int) -> DataFrame:
    """The statuses of a stream of events; needs the RocksDB state store. Arrivals should not fall from batch to batch.

    What a target alone decides is told without state. The other events reach the state in packs: tens of thousands of
    events are a few rows.
    """
    full = F.array_sort(F.array_distinct("instruments")) == F.array(*[F.lit(x) for x in sorted(set(managed))])
    stale = F.coalesce("expired", F.lit(False)) | (F.col("age_days") > stale_days)
    away = F.when(stale, REJECTED["stale"]).when(~F.coalesce(full, F.lit(False)), REJECTED["incomplete"])
    events = source.select("portfolio", "arrival", "kind", "revision", F.col("fingerprint").cast("string").alias("fingerprint"), "outcome", away.alias("away"))
    own, message = events.where("kind = 'target' and (away is not null or revision is not null)"), F.col("arrival").alias("message")
    told = F.array(F.struct(F.lit(0).alias("seq"), F.lit("received").alias("status")), F.struct(F.lit(1).alias("seq"), F.col("away").alias("status")))
    told = own.select("portfolio", message, "arrival", "revision", F.inline(F.slice(told, 1, F.when(F.col("away").isNull(), 1).otherwise(2))))
    needed = F.expr("coalesce(kind = 'retry' or kind = 'target' and away is null and revision is not null, false)")
    packs = events.select("portfolio", "arrival", "kind", F.coalesce("revision", F.lit(0)).alias("revision"), "fingerprint", "outcome", needed.alias("needed"))
    packs = packs.mapInArrow(_packed, "portfolio string, last long, events binary")
    packs = packs.withColumn("at", F.timestamp_seconds("last")).withWatermark("at", "0 seconds")
    judged = packs.groupBy("portfolio").transformWithState(Bridge(patience), OUTS, "Append", "EventTime")
    judged = judged.select("portfolio", F.inline(F.arrays_zip("message", "arrival", "seq", "revision", "status")))
    return judged.union(told.select(judged.columns))  # in this order, as a portfolio with most events takes longest


def replay(events: DataFrame, stale_days: int, managed: tuple[str, ...], patience: int, batches: int | None = None) -> DataFrame:
    """Runs ``events`` through the stream, a range of arrivals per batch, and returns what it emitted.

    Unless told, there are three batches, or as many as leave some PER_BATCH events to each. One pass deals all events to
    their batches, so that a batch reads its own alone. A state store costs every batch time, whether it holds keys or
    not; there are no more of them than cores.
    """
    spark = events.sparkSession
    folder = scratch(spark)
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    batches = batches or max(3, math.ceil(events.count() / PER_BATCH))
    dealt = events.where("arrival is not null").repartitionByRange(batches * stores, "arrival").withColumn("batch", F.floor(F.spark_partition_id() / stores).cast("int"))
    dealt.write.partitionBy("batch").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
    ours = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(stores)}
    before = {name: spark.conf.get(name, None) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        for k in range(batches):
            dealt.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            run = status_stream(source, stale_days, managed, patience).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            run.start(f"{folder}/out").awaitTermination()  # a batch on the state of the last, and one for the timers that are due
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(OUT).parquet(f"{folder}/out")
