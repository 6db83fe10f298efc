"""Universe rules on literal coins."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import universe

DAY = datetime.date(2024, 1, 1)
COIN = "id string, symbol string, name string, market_cap double, volume double, genesis string"


def coins(spark):
    old, young = "2020-01-01", "2023-12-01"
    rows = [
        ("a", "aaa", "Alpha", 100.0, 5e7, old), ("b", "BBB", None, 90.0, 5e7, old), ("c", "ccc", "C", 80.0, 5e7, old), ("d", "ddd", "D", 70.0, 5e7, old), ("e", "eee", "E", 60.0, 5e7, old),
        ("u", "usdt", "Tether", 99.0, 9e9, old), ("s", "xusd", "X", 98.0, 9e9, old), ("p", "ppp", "Pegged thing", 97.0, 9e9, old), ("w", "www", "Wrapped W", 96.0, 9e9, old), ("v", "vvv", "V", 95.0, None, old),
        ("y", "yyy", "Y", 94.0, 5e7, young), ("n", "nnn", "N", 93.0, 5e7, None), ("x", "xxx", "X", 92.0, 5e7, "soon"), ("a2", "AAA", "Alpha two", 50.0, 5e7, old), ("small", "zzz", "Z", None, 5e7, old),
    ]
    return spark.createDataFrame(rows, COIN)


def test_universe(spark):
    df = coins(spark).withColumn("genesis", F.when(F.col("genesis") != "soon", F.col("genesis")))
    scores = spark.createDataFrame([("aaa", 0.1), ("bbb", 0.2), ("ccc", 0.9), ("ccc", 0.1), ("ddd", None), ("zzz", 9.0)], "symbol string, score double")
    limits = {"top_n": 14}
    got = {r.id: (r.verdict, r.age_months) for r in universe.judged(df.repartition(3), scores, F.lit(DAY), **limits).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "kept", "b": "kept", "c": "unlocks", "d": "kept", "e": "kept", "u": "excluded", "s": "stablecoin", "p": "stablecoin", "w": "wrapped", "v": "volume", "y": "age", "n": "age", "x": "age", "a2": "kept"}
    assert got["a"][1] == (DAY - datetime.date(2020, 1, 1)).days // 30 and got["n"][1] == 0
    fixed = spark.createDataFrame([("old-ccc", "ccc"), ("old-eee", "eee"), ("luna", "luna")], "id string, symbol string")
    reference = spark.createDataFrame([("bitcoin", "BTC"), ("l", "LUNA")], "id string, symbol string")
    rows = universe.universe(df, scores, fixed, reference, F.lit(DAY), **limits)
    assert {r.symbol: (r.id, r.role) for r in rows.collect()} == {"AAA": ("a", "active"), "BBB": ("b", "active"), "DDD": ("d", "active"), "EEE": ("e", "active"), "CCC": ("old-ccc", "collapsed"), "LUNA": ("luna", "collapsed"), "BTC": ("bitcoin", "reference")}
    mandatory = spark.createDataFrame([("luna",), ("FTT",), ("ftt",)], "symbol string")
    assert [r.symbol for r in universe.missing(rows, mandatory).collect()] == ["FTT"]
    alone = universe.universe(df.limit(0), scores, fixed, reference, F.lit(DAY)).collect()
    assert {r.symbol for r in alone} == {"CCC", "EEE", "LUNA", "BTC"}
    assert universe.judged(df, scores.limit(0), F.lit(DAY), **limits).where("verdict = 'unlocks'").count() == 0


def test_ties_by_number(spark):
    """Sizes that tie at the universe's edge go by the id as a number: 9 before 10."""
    rows = [(k, f"s{k}", f"S{k}", 100.0, 5e7, "2020-01-01") for k in (10, 9, 100)]
    df = spark.createDataFrame(rows, COIN.replace("id string", "id long"))
    none = spark.createDataFrame([], "id string, symbol string")
    got = universe.universe(df, spark.createDataFrame([], "symbol string, score double"), none, none, F.lit(DAY), top_n=2)
    assert sorted(r.id for r in got.collect()) == ["10", "9"] and dict(got.dtypes)["id"] == "string"


def test_urls_and_scores(spark):
    rows = [("a", "u1", "blog", 1), ("a", "u2", "docs", None), ("a", "u3", "docs", 5), ("a", "u4", "what", 0), ("a", "u5", None, 0), ("a", "u1", "docs", 7), ("b", "u9", "blog", None)]
    got = universe.best_urls(spark.createDataFrame(rows, "asset string, url string, url_type string, priority int"), ["docs", "blog"], 4).collect()
    assert sorted((r.asset, r.place, r.url, r.url_type) for r in got) == [("a", 1, "u3", "docs"), ("a", 2, "u1", "docs"), ("a", 3, "u2", "docs"), ("a", 4, "u4", "what"), ("b", 1, "u9", "blog")]
    df = spark.createDataFrame([({"Team/Founders": 0.1, "Ecosystem": 0.2, "odd": 0.1},), ({},), (None,)], "m map<string,double>")
    assert [r.s for r in df.select(universe.unlock_score(F.col("m")).alias("s")).collect()] == [0.36, 0.0, None]
