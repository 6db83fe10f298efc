"""Policies of a bounded grid judged together: metrics by policy and span of days, the best on past days, and how it does after.

Trades are crossed with the policies that take them, once; what comes out is a row per policy and day whose figures merge
(sums, and the level, low, peak and worst fall of its compounded returns). Every span of days is made of those, so
holdout and forward selection read no trade again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import equity
from tidemark.sources.folders import checkpointed

CAPITAL = 200_000.0
#: Trades a year over days a trade, and the fewest trades that are judged.
YEAR, LEAST = 252 / 5, 5
METRICS = ["n_active", "sharpe", "cum_return", "max_dd", "win_rate", "avg_alloc"]


@dataclass(frozen=True)
class Policy:
    """A score to exceed and how it is narrowed; ``size`` is current, fixed or conservative."""

    label: str
    threshold: float
    size: str = "current"
    top_n: int | None = None
    regime_min: float | None = None
    cooldown: int | None = None
    daily_cap: float | None = None
    alloc: float = 0.01

    def most(self) -> int | None:
        """Trades a day, by rank and by the daily cap on exposure."""
        caps = [n for n in (self.top_n, None if self.daily_cap is None else int(self.daily_cap / self.alloc + 1e-12)) if n is not None]
        return min(caps, default=None)


def _positions(policies: list[Policy]) -> Column:
    current = F.col("position")
    sizes = {"current": current, "fixed": F.lit(CAPITAL * 0.01), "conservative": F.least(current * 0.5, F.lit(CAPITAL * 0.02))}
    return F.coalesce(*[F.when(F.col("size") == k, v) for k, v in sizes.items()])


def policy_trades(df: DataFrame, policies: list[Policy]) -> DataFrame:
    """Trades (row_id, date, symbol, score, regime, pnl, position) of every policy that takes them: label, date, symbol, row_id, pnl, alloc, ret.

    Of a symbol's trades of a day the best (then the first) decides on the pause after it and alone can stay under one.
    Days' best trades are by score, then row. Null scores, regimes and positions count as 0; trades without date can't
    be judged. Allocations under a thousandth of the capital are none.
    """
    fields = ["label", "threshold", "size", "most", "regime_min", "cooldown"]
    rows = [dict(zip(fields, (p.label, p.threshold, p.size, p.most(), p.regime_min, p.cooldown))) for p in policies]
    kinds = dict(zip(fields, ("string", "double", "string", "int", "double", "int")))
    grid = F.array(*[F.struct(*[F.lit(r[f]).cast(kinds[f]).alias(f) for f in fields]) for r in rows])
    score, regime = F.coalesce("score", F.lit(0.0)), F.coalesce("regime", F.lit(0.0))
    own = df.where("date is not null").select("row_id", "date", "symbol", score.alias("score"), regime.alias("regime"), "pnl", F.coalesce("position", F.lit(0.0)).alias("position"))
    taken = own.select("*", F.inline(F.filter(grid, lambda p: (F.col("score") > p["threshold"]) & (p["regime_min"].isNull() | (F.col("regime") >= p["regime_min"])))))
    if any(p.cooldown for p in policies):
        taken = _rested(taken)
    if any(p.most() is not None for p in policies):
        best = F.row_number().over(Window.partitionBy("label", "date", (F.col("most").isNull()).alias("_all"), F.when(F.col("most").isNull(), F.col("row_id"))).orderBy(F.desc("score"), "row_id"))
        taken = taken.withColumn("_best", best).where(F.col("most").isNull() | (F.col("_best") <= F.col("most")))
    alloc = F.greatest(F.least(_positions(policies) / CAPITAL, F.lit(0.25)), F.lit(0.0))
    taken = taken.withColumn("alloc", alloc).where("alloc > 0.001")
    return taken.select("label", "date", "symbol", "row_id", "pnl", "alloc", (F.greatest(F.least("pnl", F.lit(2.0)), F.lit(-0.5)) * F.col("alloc")).alias("ret"))


def _rested(taken: DataFrame) -> DataFrame:
    """Leaves out trades within the pause after a kept one of the same policy and symbol; folds a symbol's days, not its trades."""
    resting = taken.where("cooldown > 0")
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    first = resting.groupBy("label", "symbol", "cooldown", day.alias("_d")).agg(F.max_by("row_id", F.struct("score", -F.col("row_id"))).alias("row_id"))
    take = lambda kept, d: (F.size(kept) == 0) | (d - F.try_element_at(kept, F.lit(-1)) > F.col("cooldown"))
    fold = F.aggregate(F.col("_ds"), F.array().cast("array<int>"), lambda kept, d: F.when(take(kept, d), F.array_append(kept, d)).otherwise(kept))
    kept = first.groupBy("label", "symbol", "cooldown").agg(F.sort_array(F.collect_list("_d")).alias("_ds")).select("label", "symbol", F.explode(fold).alias("_d"))
    rows = first.join(kept, ["label", "symbol", "_d"], "left_semi").select("label", "row_id")
    return taken.where("cooldown is null or cooldown = 0").unionByName(taken.where("cooldown > 0").join(rows, ["label", "row_id"], "left_semi"))


def by_day(trades: DataFrame) -> DataFrame:
    """A row per policy and day that merges: n, wins, alloc, sum and square of returns, grown level, low, peak, worst fall.

    Trades of a day go by symbol and row. A day may hold any number of them: its running values are dealt by range.
    """
    run = equity(trades, ["label", "date"], ["symbol", "row_id"], "ret")
    sums = [F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("alloc").alias("alloc"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q")]
    return run.groupBy("label", "date").agg(*sums, F.exp(F.sum(F.ln(1 + F.col("ret")))).alias("level"), F.min("equity").alias("low"), F.max("peak").alias("peak"), F.min("drawdown").alias("worst"))


def span_metrics(days: DataFrame, spans: DataFrame) -> DataFrame:
    """(label, span, *METRICS) of the days of each of ``spans`` (span, first, last: days, both included), a few of them.

    A policy with fewer than five trades in a span has figures of 0; one without any has no row.
    """
    held = days.join(F.broadcast(spans.select("span", "first", "last")), F.col("date").between(F.col("first"), F.col("last")))  # spans are few
    step = lambda s, d: F.struct(
        (s["level"] * d["level"]).alias("level"), F.greatest(s["peak"], s["level"] * d["peak"]).alias("peak"), F.least(s["worst"], d["worst"], s["level"] * d["low"] / s["peak"] - 1).alias("worst")
    )
    start = F.struct(F.lit(1.0).alias("level"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))
    path = F.aggregate(F.sort_array(F.collect_list(F.struct("date", "level", "peak", "low", "worst"))), start, step)  # an element per day
    one = held.groupBy("label", "span").agg(*[F.sum(c).alias(c) for c in ("n", "wins", "alloc", "s", "q")], path.alias("path"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    figures = {"sharpe": mean / (spread + 1e-10) * F.sqrt(F.lit(YEAR)), "cum_return": F.col("path.level") - 1, "max_dd": -F.col("path.worst"), "win_rate": F.col("wins") / F.col("n"), "avg_alloc": F.col("alloc") / F.col("n")}
    return one.select("label", "span", F.col("n").alias("n_active"), *[F.when(F.col("n") >= LEAST, v).otherwise(0.0).alias(k) for k, v in figures.items()])


def spans_of(df: DataFrame, share: float = 0.2, test: float = 0.1, folds: int = 4, train: int = 252, least: int = 90) -> DataFrame:
    """(span, part, first, last, n_days): all days; train and test of the holdout; train and test of the forward folds.

    From 320 days on the last fifth (90 days at least, 252 left for training) is held out; from 400 on, up to ``folds``
    blocks of a tenth (90 at least) at the end are tested, each after all days before it.
    """
    one = df.where("date is not null").agg(F.sort_array(F.collect_set("date")).alias("d"))  # the table's days
    n = F.size("d")
    held = F.least(F.greatest(F.floor(n * share).cast("int"), F.lit(least)), F.greatest(n - train, F.lit(least)))
    block = F.greatest(F.floor(n * test).cast("int"), F.lit(least))
    count = F.least(F.lit(folds), F.greatest(F.floor((n - train) / block).cast("int"), F.lit(0)))
    span = lambda name, part, a, b: F.struct(name.alias("span"), F.lit(part).alias("part"), F.get("d", a).alias("first"), F.get("d", b).alias("last"), (b - a + 1).alias("n_days"))
    whole = F.array(span(F.lit("all"), "all", F.lit(0), n - 1))
    out = F.when((n >= 320) & (n - held >= train), F.array(span(F.lit("holdout_train"), "train", F.lit(0), n - held - 1), span(F.lit("holdout_test"), "test", n - held, n - 1))).otherwise(F.slice(whole, 1, 0))
    at = lambda k: (n - count * block + k * block).cast("int")
    name = lambda k, part: F.concat(F.lit("fold_"), (k + 1).cast("string"), F.lit(f"_{part}"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.array(span(name(k, "train"), "train", F.lit(0), at(k) - 1), span(name(k, "test"), "test", at(k), at(k) + block - 1))))
    forward = F.when((n >= 400) & (count > 0), pairs).otherwise(F.slice(whole, 1, 0))
    return one.where(n > 0).select(F.inline(F.concat(whole, out, forward)))


def in_order(*keys: str) -> Column:
    """The place of a candidate: by Sharpe ratio, return, smallest fall, number of trades, then name."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sharpe"), F.desc("cum_return"), F.asc("max_dd"), F.desc("n_active"), "label"))


def grid_metrics(df: DataFrame, policies: list[Policy]) -> tuple[DataFrame, DataFrame]:
    """Metrics of all policies in all spans, and the spans. Policies without a trade in a span have figures of 0."""
    spans = checkpointed(spans_of(df))
    days = checkpointed(by_day(policy_trades(df, policies)))
    every = spans.select("span").withColumn("label", F.explode(F.array(*[F.lit(p.label) for p in policies])))
    return checkpointed(every.join(span_metrics(days, spans), ["label", "span"], "left").na.fill(0, METRICS)), spans


def selection(metrics: DataFrame, benchmark: str) -> DataFrame:
    """A row per pair of train and test spans: the policy that was best in training, and how it and the benchmark do in the test."""
    test = metrics.where(F.col("span").endswith("_test")).withColumn("split", F.regexp_replace("span", "_test$", ""))
    train = metrics.where(F.col("span").endswith("_train")).withColumn("split", F.regexp_replace("span", "_train$", ""))
    chosen = train.withColumn("_place", in_order("split")).where("_place = 1").select("split", F.col("label").alias("chosen"), F.col("sharpe").alias("train_sharpe"))
    figures = lambda df, side: df.select("split", *[F.col(c).alias(f"{side}_{c}") for c in ("n_active", "sharpe", "cum_return", "max_dd")])
    own = test.join(chosen, (test.split == chosen.split) & (test.label == chosen.chosen)).drop(chosen.split)
    return chosen.join(figures(own, "chosen"), "split").join(figures(test.where(F.col("label") == benchmark), "benchmark"), "split").withColumn("matches", F.col("chosen") == benchmark)
