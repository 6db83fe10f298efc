"""Unlock layers of an asset and day: observed snapshots, documents reconstructed as of the day, and market proxies.

Layers are aligned by (asset, date); each field comes from the first layer that has it, and where it came from is kept.
Documents are parsed once, before the day that reads them is known; the day takes the latest one that is not after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import payloads, text
from tidemark.operators import unlocks, windows

#: Share of unknown tokens that blocks a layer, confidence to keep and to promote, shares of its five parts.
UNKNOWN_MOST, EVIDENCE_LEAST, PROMOTE_LEAST = 0.15, 0.70, 0.85
PARTS = {"source": 0.35, "parse": 0.20, "agreement": 0.20, "supply": 0.15, "time": 0.10}
BLOGS = ("medium.com", "mirror.xyz", "substack.com")
LAYER = ["raw", "unknown", "insider", "quality", "supply", "at"]


def _total(items: Column, value: str, keep=lambda x: F.lit(True)) -> Column:
    return F.aggregate(F.filter(items, keep), F.lit(0.0), lambda s, x: s + F.greatest(x[value], F.lit(0.0)))


def unknown_share(events: Column) -> Column:
    """Share of tokens in no known bucket; 0 without tokens."""
    whole = _total(events, "tokens")
    return F.when(whole > 0, _total(events, "tokens", lambda e: e["bucket"] == "Other") / whole).otherwise(0.0)


def insider_share(items: Column) -> Column:
    """Share of insiders in the known buckets of a distribution; null without any."""
    known = _total(items, "value", lambda x: x["bucket"].isin(*unlocks.WEIGHTS))
    return F.when(known > 1e-9, F.least(_total(items, "value", lambda x: x["bucket"].isin(*unlocks.INSIDERS)) / known, F.lit(1.0)))


def pressure(events: Column, day: Column, circ: Column, days: int = 30) -> Column:
    """Weighted tokens of the ``days`` days after a day over supply; null where supply is not above 0."""
    near = F.filter(events, lambda e: (F.datediff(e["event_date"], day) > 0) & (F.datediff(e["event_date"], day) <= days))
    weighed = F.aggregate(near, F.lit(0.0), lambda s, e: s + F.coalesce(unlocks.weight(e["bucket"]), F.lit(0.0)) * e["tokens"])
    return F.when(circ > 0, weighed / circ)


def _some(*values: Column) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*[F.when(v != 0, v) for v in values])


def latest_day(market: DataFrame) -> DataFrame:
    """Each asset's rows of its last day."""
    last = market.groupBy("asset").agg(F.max("date").alias("date"))
    return market.join(last, ["asset", "date"], "left_semi")


def observed_layer(snapshots: DataFrame, market: DataFrame) -> DataFrame:
    """(asset, date, raw, unknown, insider, quality, supply, at) from JSON ``snapshots`` (asset, at, payload), the last of a day.

    Supply in circulation comes from the payload, else from the market's day. Quality is missing_schedule or
    unparsed_schedule without events, invalid_circ without supply, review_required with too many unknown tokens, else ok;
    only then there is a raw pressure.
    """
    found = {"schedule": payloads.SCHEDULES, "distribution": payloads.DISTRIBUTIONS, **payloads.METRICS}
    rows = snapshots.groupBy("asset", F.to_date("at").alias("date")).agg(F.max_by("payload", "at").alias("payload"), F.max("at").alias("at"))
    rows = rows.select("asset", "date", "at", *[payloads.json_find_first(F.col("payload"), keys).alias(n) for n, keys in found.items()])
    known = market.select("asset", "date", F.col("circ_approx").alias("_circ"), F.col("total_supply").alias("_supply"))
    rows = rows.join(known, ["asset", "date"], "left")
    circ = _some(text.safe_float(F.col("circulating_supply")), F.col("_circ"))
    supply = _some(text.safe_float(F.col("total_supply")), F.col("_supply"))
    rows = rows.select("asset", "date", "at", "schedule", circ.alias("circ"), supply.alias("supply"), payloads.schedule_events(F.col("schedule"), supply).alias("events"), payloads.distribution_items(F.col("distribution")).alias("items"))
    unknown = unknown_share(F.col("events"))
    held = F.col("schedule").isNotNull() & ~F.regexp_replace("schedule", r"\s", "").isin("[]", "{}")
    quality = (
        F.when(F.size("events") == 0, F.when(held, "unparsed_schedule").otherwise("missing_schedule"))
        .when(~F.coalesce(F.col("circ") > 0, F.lit(False)), "invalid_circ")
        .when(unknown > UNKNOWN_MOST, "review_required")
        .otherwise("ok")
    )
    raw = F.when(quality == "ok", pressure(F.col("events"), F.col("date"), F.col("circ")))
    return rows.select("asset", "date", raw.alias("raw"), unknown.alias("unknown"), insider_share(F.col("items")).alias("insider"), quality.alias("quality"), "supply", "at")


def parsed_captures(captures: DataFrame) -> DataFrame:
    """``captures`` (asset, at, mime, url, content) read by their kinds: asset, at, html, url, score, events, items, hint."""
    kind = payloads.document_kind(F.col("mime"), F.col("url"))
    rows = captures.withColumn("_kind", kind).withColumn("_rows", payloads.document_rows(F.col("content"), F.col("_kind")))
    n = F.size("_rows")
    score = F.when(F.col("_kind") == "text", F.when(n > 0, 0.3).otherwise(0.0)).otherwise(F.when(n > 0, 1.0).otherwise(0.3))
    events, items, hint = payloads.row_events(F.col("_rows")), payloads.row_distribution(F.col("_rows")), payloads.supply_hint(F.col("_rows"))
    html = F.coalesce(F.lower("mime").contains("html"), F.lit(False)).cast("int")
    return rows.select("asset", "at", html.alias("html"), "url", score.alias("score"), (n > 0).alias("structured"), events.alias("events"), items.alias("items"), hint.alias("hint"))


def official(url: Column) -> Column:
    """Whether an address has a host that is no blog's."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^/]*://([^/]*)", 1)), r"^www\.", "")
    blog = F.lit(False)
    for b in BLOGS:
        blog = blog | host.endswith(b)
    return F.coalesce(url.contains("://"), F.lit(False)) & ~blog


def confidence(source: Column, parse: Column, supply: Column, agreement: float = 0.5, time: float = 1.0) -> Column:
    return PARTS["source"] * source + PARTS["parse"] * parse + F.lit(PARTS["agreement"] * agreement) + PARTS["supply"] * supply + F.lit(PARTS["time"] * time)


def reconstructed_layer(captures: DataFrame, market: DataFrame) -> DataFrame:
    """(asset, date, raw, unknown, insider, quality, supply, at, confidence) of every day of ``market`` (asset, date, circ_approx).

    A day reads the capture of the latest day not after it (HTML before other kinds, then the latest). Quality is
    no_capture without one, confidence_rejected or evidence_only below the two limits of confidence, else
    unstructured_payload, review_required or ok; raw pressure needs confidence, supply and few unknown tokens.
    """
    read = parsed_captures(captures)
    rest = ["url", "score", "structured", "events", "items", "hint", "at"]
    best = read.groupBy("asset", F.to_date("at").alias("date")).agg(F.max_by(F.struct(*rest), F.struct("html", "at")).alias("doc"))
    days = market.select("asset", "date", F.col("circ_approx").alias("circ"))
    rows = windows.as_of(days, best, "asset", "date", ["doc"]).select("asset", "date", "circ", "doc.*")
    tokens, unknown, none = _total(F.col("events"), "tokens"), unknown_share(F.col("events")), F.col("at").isNull()
    consistent = F.when((F.col("circ") > 0) & (tokens <= F.col("circ") * 100), 1.0).when(tokens > 0, 0.5).otherwise(0.0)
    sure = F.when(~none, F.round(confidence(F.when(official(F.col("url")), 1.0).otherwise(0.75), F.when(F.size("events") > 0, F.col("score")).otherwise(0.0), consistent), 12))
    quality = (
        F.when(none, "no_capture").when(sure < EVIDENCE_LEAST, "confidence_rejected").when(sure < PROMOTE_LEAST, "evidence_only")
        .when(~F.col("structured"), "unstructured_payload").when(unknown > UNKNOWN_MOST, "review_required").otherwise("ok")
    )
    raw = F.when((sure >= PROMOTE_LEAST) & (unknown <= UNKNOWN_MOST), pressure(F.col("events"), F.col("date"), F.col("circ")))
    return rows.select("asset", "date", raw.alias("raw"), F.when(~none, unknown).otherwise(0.0).alias("unknown"), insider_share(F.col("items")).alias("insider"), quality.alias("quality"), F.col("hint").alias("supply"), "at", sure.alias("confidence"))


def assemble(market: DataFrame, observed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A row per row of ``market`` (asset, date, circ_approx, total_supply, market_cap, avg_30d_volume) with its layers.

    Columns: asset, date, raw_observed, raw_reconstructed, raw_proxy_full, raw_proxy_fallback, insider, insider_mode,
    supply, supply_mode, unknown, quality, source, confidence, lag_days. Layers have each (asset, date) once; a missing
    layer is of quality "missing". A review of either layer is one of the row.
    """

    def side(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return df.select("asset", "date", *[F.col(c).alias(f"{name}_{c}") for c in columns])

    rows = market.join(side(observed, "o", LAYER), ["asset", "date"], "left").join(side(rebuilt, "r", [*LAYER, "confidence"]), ["asset", "date"], "left")
    c = F.col
    insider = F.coalesce("o_insider", "r_insider", F.lit(0.0))
    positive = lambda x: F.when(x > 0, x)
    supply = F.coalesce(positive(c("o_supply")), positive(c("r_supply")), positive(c("total_supply")))
    mode = F.when(supply == c("o_supply"), "observed_supply").when(supply == c("r_supply"), "reconstructed_supply").when(supply.isNotNull() & c("total_supply").isNotNull(), "market_supply").otherwise("market_chart_circ_approx")
    traded = (c("market_cap") > 0) & (c("avg_30d_volume") > 0)
    fallback = F.when(traded, unlocks.proxy_fallback(c("market_cap"), c("avg_30d_volume"), insider))
    full = F.when(traded & (c("circ_approx") > 0), unlocks.proxy_full(supply, c("circ_approx"), c("market_cap"), c("avg_30d_volume"), insider))
    o_quality, r_quality = (F.coalesce(x, F.lit("missing")) for x in ("o_quality", "r_quality"))
    quality = (
        F.when((o_quality == "review_required") | (r_quality == "review_required"), "review_required").when(c("o_raw").isNotNull(), o_quality).when(c("r_raw").isNotNull(), r_quality)
        .when(full.isNotNull(), "proxy_full").when(fallback.isNotNull(), "proxy_fallback").otherwise(o_quality)
    )
    source = F.when(c("o_at").isNotNull(), "observed").when(c("r_at").isNotNull(), "captured").when(full.isNotNull(), "proxy_full").when(fallback.isNotNull(), "proxy_fallback")
    origin = F.when(c("o_insider").isNotNull(), "observed").when(c("r_insider").isNotNull(), "reconstructed").otherwise("missing_zeroed")
    return rows.select(
        "asset", "date", c("o_raw").alias("raw_observed"), c("r_raw").alias("raw_reconstructed"), full.alias("raw_proxy_full"), fallback.alias("raw_proxy_fallback"), insider.alias("insider"), origin.alias("insider_mode"),
        supply.alias("supply"), mode.alias("supply_mode"), F.greatest(F.coalesce("o_unknown", F.lit(0.0)), F.coalesce("r_unknown", F.lit(0.0))).alias("unknown"), quality.alias("quality"), source.alias("source"),
        c("r_confidence").alias("confidence"), F.datediff("date", F.to_date(F.coalesce("o_at", "r_at"))).alias("lag_days"), o_quality.alias("_o_quality"), r_quality.alias("_r_quality"),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank_<layer> of each day, on values clipped at its 1 and 99 % points, and the rank that counts with its state.

    The observed rank counts if its layer is ok, the reconstructed if it is ok and sure enough, then the proxies. A day's
    rows, one per asset, are ranked together.
    """
    layers = ("observed", "reconstructed", "proxy_full", "proxy_fallback")
    day = Window.partitionBy("date")
    clipped = {f"_c_{k}": F.greatest(F.least(F.col(f"raw_{k}"), F.percentile(f"raw_{k}", F.lit(0.99)).over(day)), F.percentile(f"raw_{k}", F.lit(0.01)).over(day)) for k in layers}
    clipped = {k: F.when(F.col(k.replace("_c_", "raw_")).isNotNull(), v) for k, v in clipped.items()}
    rows = rows.withColumns(clipped)
    rows = rows.withColumns({f"rank_{k}": windows.percent_rank_average(F.col(f"_c_{k}"), ["date"]) for k in layers})
    sure = (F.coalesce("confidence", F.lit(0.0)) >= PROMOTE_LEAST) & (F.col("_r_quality") == "ok")
    usable = [F.when(F.col("_o_quality") == "ok", F.col("rank_observed")), F.when(sure, F.col("rank_reconstructed")), F.col("rank_proxy_full"), F.col("rank_proxy_fallback")]
    return rows.withColumns({"rank": F.coalesce(*usable), "state": unlocks.state(*usable)}).drop(*clipped, "_o_quality", "_r_quality")
