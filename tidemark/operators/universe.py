"""The universe of a day: the largest assets that are old, traded and free enough, with those that collapsed kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import EXCLUDED_SYMBOLS, is_stablecoin
from tidemark.operators.unlocks import WEIGHTS

#: Fixed value: the weight of a category that is none of the buckets.
OTHER = 0.5


def unlock_score(shares: Column) -> Column:
    """The weighted sum of a map from category to share of supply that unlocks in 30 days, rounded to 6 places."""
    weight = lambda k: F.coalesce(*[F.when(k == name, w) for name, w in WEIGHTS.items()], F.lit(OTHER))
    return F.round(F.aggregate(F.map_entries(shares), F.lit(0.0), lambda s, e: s + weight(e["key"]) * F.coalesce(e["value"], F.lit(0.0))), 6)


def judged(coins: DataFrame, scores: DataFrame, as_of: Column, top_n: int = 50, volume: float = 20_000_000, months: int = 18, share: float = 0.75) -> DataFrame:
    """The ``top_n`` largest of ``coins`` (id, symbol, name, market_cap, volume, genesis) with their score and ``verdict``.

    The first rule that is broken decides: excluded, stablecoin, wrapped, volume, age; of those left, the score of
    ``scores`` (symbol, score) above its 75 % point is unlocks. The others are kept, those without a score among them. An
    age is whole months of 30 days, 0 without a day of origin; a null volume is 0. Sizes that tie go by id. A symbol is in
    upper case; of several scores of one the largest counts.
    """
    top = coins.orderBy(F.desc_nulls_last("market_cap"), "id").limit(top_n)  # the universe's size is a parameter
    age = F.coalesce(F.floor(F.datediff(as_of, F.to_date("genesis")) / 30), F.lit(0)).cast("int")
    rows = top.select("id", F.upper("symbol").alias("symbol"), F.coalesce("name", F.lit("")).alias("name"), "market_cap", F.coalesce("volume", F.lit(0.0)).alias("volume"), age.alias("age_months"))
    broken = (
        F.when(F.col("symbol").isin(*EXCLUDED_SYMBOLS), "excluded").when(is_stablecoin(F.col("symbol"), F.col("name")), "stablecoin").when(F.upper("name").contains("WRAPPED"), "wrapped")
        .when(F.col("volume") < volume, "volume").when(F.col("age_months") < months, "age")
    )
    best = scores.groupBy(F.upper("symbol").alias("symbol")).agg(F.max("score").alias("score"))
    rows = rows.withColumn("_broken", broken).join(best, "symbol", "left")
    cut = F.percentile(F.when(F.col("_broken").isNull(), F.col("score")), F.lit(share)).over(Window.partitionBy(F.lit(0)))  # top_n rows
    return rows.withColumn("verdict", F.coalesce("_broken", F.when(F.col("score") > cut, "unlocks"), F.lit("kept"))).drop("_broken")


def universe(coins: DataFrame, scores: DataFrame, collapsed: DataFrame, reference: DataFrame, as_of: Column, **limits) -> DataFrame:
    """(symbol, id, role, score): the kept coins, then the ``collapsed`` (id, symbol), then the ``reference`` assets (id, symbol) that are in neither.

    A symbol is in once: in the first role, and there with the largest asset, or the smallest id as a string. The largest
    ``coins`` are taken by their id as it is, so numbers tie as numbers; ids come out as strings. Collapsed assets are
    exempt from all rules.
    """
    kept = judged(coins, scores, as_of, **limits).where("verdict = 'kept'").select("symbol", F.col("id").cast("string").alias("id"), F.lit("active").alias("role"), "score", "market_cap", F.lit(0).alias("_r"))
    fixed = lambda df, role, r: df.select(F.upper("symbol").alias("symbol"), "id", F.lit(role).alias("role"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("market_cap"), F.lit(r).alias("_r"))
    every = kept.union(fixed(collapsed, "collapsed", 1)).union(fixed(reference, "reference", 2))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("_r", F.desc_nulls_last("market_cap"), "id"))  # a few rows a symbol
    return every.withColumn("_first", first).where("_first = 1").select("symbol", "id", "role", "score")


def missing(universe: DataFrame, mandatory: DataFrame) -> DataFrame:
    """The symbols of ``mandatory`` that the universe lacks."""
    return mandatory.select(F.upper("symbol").alias("symbol")).distinct().join(universe, "symbol", "left_anti")


def best_urls(urls: DataFrame, order: list[str], most: int) -> DataFrame:
    """``urls`` (asset, url, url_type, priority) to read first: at most ``most`` an asset, by the place of their type, then priority, then address.

    Unknown types come last, a missing priority counts as 999; an asset's address is in once, at its best.
    """
    place = F.coalesce(*[F.when(F.col("url_type") == t, k) for k, t in enumerate(order)], F.lit(99))
    rank = F.struct(place.alias("t"), F.coalesce("priority", F.lit(999)).alias("p"))
    one = urls.groupBy("asset", "url").agg(F.min(F.struct(rank.alias("r"), "url_type", "priority")).alias("x"))
    rows = one.withColumn("place", F.row_number().over(Window.partitionBy("asset").orderBy("x.r", "url")))  # an asset's addresses
    return rows.where(F.col("place") <= most).select("asset", "place", "url", "x.url_type", "x.priority")
