"""Target portfolios: acceptance of revisions, in batch and as a stream, and reconciliation with positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import running

STATE = "revision long, prints string"


def _turned_away(targets: DataFrame, stale_days: int, managed: tuple[str, ...]) -> DataFrame:
    """Adds ``away``: why a target is turned away before its revision is looked at, or null."""
    full = F.array_sort(F.array_distinct("instruments")) == F.array(*[F.lit(x) for x in sorted(set(managed))])
    stale = F.coalesce("expired", F.lit(False)) | (F.col("age_days") > stale_days)
    return targets.withColumn("away", F.when(stale, "stale").when(~F.coalesce(full, F.lit(False)), "incomplete"))


def ladder(targets: DataFrame, stale_days: int, managed: tuple[str, ...]) -> DataFrame:
    """(portfolio, arrival, revision, status) of targets in order of arrival.

    Expired or too old is stale; other instruments than the managed ones are incomplete; both leave no trace. A revision
    above all before it is accepted; below it is out of order; at it, a duplicate if its fingerprint is that of the
    first with the revision, else a conflict. Arrivals are numbers, each met once in a portfolio.
    """
    marked = _turned_away(targets, stale_days, managed)
    fresh = marked.where("away is null").select("portfolio", "arrival", "revision", "fingerprint")
    seen = running(fresh, ["portfolio"], [F.col("arrival")], {"before": (F.max, "revision", None)})
    first = fresh.groupBy("portfolio", "revision").agg(F.min_by("fingerprint", "arrival").alias("first"))
    status = F.when(F.col("before").isNull() | (F.col("revision") > F.col("before")), "accepted").when(F.col("revision") < F.col("before"), "out_of_order")
    status = status.when(F.col("fingerprint").eqNullSafe(F.col("first")), "duplicate").otherwise("conflict")
    done = seen.join(first, ["portfolio", "revision"]).select("portfolio", "arrival", "revision", status.alias("status"))
    return done.union(marked.where("away is not null").select("portfolio", "arrival", "revision", "away"))


def _accept(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Revisions of one portfolio in one batch, in order of arrival, after the state's last accepted one."""
    best, fp = (state.get if state.exists else (None, None))
    rows = pd.concat(list(frames)).sort_values("arrival")
    before = rows.revision.cummax().shift()
    if best is not None:
        before = before.fillna(best).clip(lower=best)
    prints = rows.fingerprint.astype(str)
    first = prints.groupby(rows.revision).transform("first")
    if best is not None:
        first = first.where(rows.revision != best, fp)
    status = np.select([before.isna() | (rows.revision > before), rows.revision < before, prints == first], ["accepted", "out_of_order", "duplicate"], "conflict")
    top = int(rows.revision.max())
    if best is None or top > best:
        best, fp = top, str(first[rows.revision == top].iloc[0])
    state.update((best, fp))
    yield rows[["portfolio", "arrival", "revision"]].assign(status=status)


def accept_stream(source: DataFrame, stale_days: int, managed: tuple[str, ...]) -> DataFrame:
    """The acceptance ladder over a stream; the state of a portfolio is its last accepted revision and fingerprint."""
    fresh = _turned_away(source, stale_days, managed).where("away is null").select("portfolio", "arrival", "revision", "fingerprint")
    return fresh.groupBy("portfolio").applyInPandasWithState(_accept, "portfolio string, arrival long, revision long, status string", STATE, "append", "NoTimeout")


def stream(targets: DataFrame, stale_days: int, managed: tuple[str, ...], batches: int = 4) -> DataFrame:
    """Runs ``targets`` through the stream, a range of arrivals per file and batch, and returns what it emitted.

    A file source takes files by time of change, so the ranges are written one after the other.
    """
    from tidemark.sources.folders import scratch

    folder, spark = scratch(targets.sparkSession), targets.sparkSession
    edges = targets.agg(F.percentile_approx("arrival", F.array(*[F.lit(k / batches) for k in range(1, batches)]), 1000).alias("e")).first()["e"] or []
    bounds = [None, *sorted(set(edges)), None]
    schema = "portfolio string, arrival long, revision long, status string"
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = targets.where((F.lit(True) if lo is None else F.col("arrival") > lo) & (F.lit(True) if hi is None else F.col("arrival") <= hi))
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(targets.schema).parquet(f"{folder}/in")
        run = accept_stream(source, stale_days, managed).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        run.start(f"{folder}/out").awaitTermination()  # each run takes the files that are new as a batch, on the state of the last
    return spark.read.schema(schema).parquet(f"{folder}/out")


def reconcile(rows: DataFrame, nav: float, band: float, dust: float, least: float) -> DataFrame:
    """Adds intent and delta (notional) from weight, price and quantity; a null price yields no order."""
    goal, held = F.col("weight") * nav, F.coalesce("quantity", F.lit(0.0)) * F.col("price")
    delta = goal - held
    flat = F.col("weight") == 0
    intent = (
        F.when(F.col("price").isNull(), "no_price")
        .when(flat & (F.col("quantity") == 0), "already_flat")
        .when(flat & (held < dust), "dust_close")
        .when(flat, "close")
        .when(F.abs(delta) <= nav * band, "noop_band")
        .when(F.abs(delta) < least, "min_notional")
        .otherwise(F.when(goal > held, "buy").otherwise("sell"))
    )
    return rows.withColumn("intent", intent).withColumn("delta", delta)
