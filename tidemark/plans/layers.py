"""Unlock layers over snapshots and pages written from the given tables, month by month."""

from pyspark.sql import functions as F

from tidemark.operators import layers
from tidemark.plans.register import registry
from tidemark.sources.folders import checkpointed
from tidemark.sources.views import AS_OF, unlock_as_of

query, QUERIES, ORACLES = registry()


def _month():
    return F.year("date") * 12 + F.month("date")


def _market(spark, sf):
    a = F.col("asset")
    df = unlock_as_of(spark, sf).withColumnRenamed("as_of", "date")
    return df.select(a, "date", F.col("circ").alias("circ_approx"), F.when(a % 4 > 0, 2 * F.col("circ")).alias("total_supply"), F.when(a % 7 != 3, 50 * F.col("circ")).otherwise(0.0).alias("market_cap"), (1000.0 + 13 * a).alias("avg_30d_volume"))


def _snapshots(market):
    """A payload every third month; some without a schedule, some with rows that are none."""
    a = F.col("asset")
    event = F.concat(F.lit('{"date": "'), F.date_add("date", 10), F.lit('", "label": "'), F.when(a % 5 == 0, "mystery").otherwise("Core Team"), F.lit('", "tokens": '), (10 + a).cast("string"), F.lit("}, "))
    later = F.concat(F.lit('{"date": "'), F.date_add("date", 40), F.lit('", "label": "Seed sale", "tokens": "10"}'))
    rows = F.when(a % 6 == 0, "").when(a % 6 == 1, '{"x": 1}').otherwise(F.concat(event, later))
    payload = F.concat(F.lit('{"data": {"unlocks": ['), rows, F.lit('], "distribution": [{"label": "Team", "share": '), (10 + a).cast("string"), F.lit('}, {"label": "Rewards", "share": '), (90 - a).cast("string"), F.lit("}]}}"))
    return market.where((_month() + a) % 3 == 0).select("asset", (F.timestamp_seconds(F.unix_timestamp("date") + 3600)).alias("at"), payload.alias("payload"))


def _captures(market):
    """A page every half year of the even assets, on their own site or on a blog; a file of the same day that is not read."""
    a = F.col("asset")
    page = F.concat(F.lit("<table><tr><th>Unlock date</th><th>Category</th><th>Amount</th><th>max_supply</th></tr><tr><td>"), F.date_add("date", 20), F.lit("</td><td>Advisors</td><td>100</td><td>5000</td></tr></table>"))
    url = F.when(a % 4 == 0, "https://www.example.org/docs").otherwise("https://x.medium.com/docs")
    rows = market.where((_month() % 6 == 0) & (a % 2 == 0)).withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.date_sub("date", 5))))
    html = rows.select("asset", "at", F.lit("text/html").alias("mime"), url.alias("url"), page.alias("content"))
    return html.union(rows.select("asset", F.timestamp_seconds(F.unix_timestamp("at") + 60), F.lit("text/csv"), url, F.lit("date,label\n")))


def _assembled(spark, sf):
    market = checkpointed(_market(spark, sf))
    return layers.ranked(layers.assemble(market, layers.observed_layer(_snapshots(market), market), layers.reconstructed_layer(_captures(market), market)))


SQL = f"with {AS_OF}" + """, m as (select asset, as_of "date", circ, case when asset % 4 > 0 then 2 * circ end total, case when asset % 7 <> 3 then 50 * circ else 0 end cap, 1000.0::double + 13 * asset vol, year(as_of) * 12 + month(as_of) mon from as_of),
  o as (select *, asset % 6 not in (0, 1) has, (10 + asset)::double t from m where (mon + asset) % 3 = 0),
  obs as (select asset, "date", case when has and asset % 5 <> 0 then 1.5 * t / circ end o_raw, case when has and asset % 5 = 0 then t / (t + 10) else 0 end o_unknown, (10 + asset) / 100.0::double o_insider, total o_supply,
    case when asset % 6 = 0 then 'missing_schedule' when asset % 6 = 1 then 'unparsed_schedule' when asset % 5 = 0 then 'review_required' else 'ok' end o_quality from o),
  cap as (select asset, "date" cdate from m where mon % 6 = 0 and asset % 2 = 0),
  r as (select m.asset, m."date", circ, max(cdate) cdate from m left join cap on cap.asset = m.asset and cap.cdate - 5 <= m."date" group by all),
  rec as (select asset, "date", cdate, case when cdate is null then null when asset % 4 = 0 then 0.9 else 0.8125 end::double conf, case when cdate is null then 'no_capture' when asset % 4 = 0 then 'ok' else 'evidence_only' end r_quality,
    case when asset % 4 = 0 and cdate is not null then case when cdate + 20 > "date" and cdate + 20 <= "date" + 30 then 1.5 * 100 / circ else 0 end end r_raw, case when cdate is not null then 1.0 end r_insider, case when cdate is not null then 5000.0 end::double r_supply from r),
  j as (select m.*, o_raw, coalesce(o_unknown, 0) unknown, o_insider, o_supply, coalesce(o_quality, 'missing') oq, o_quality is not null seen, cdate, conf, r_quality rq, r_raw, r_insider, r_supply from m left join obs using (asset, "date") join rec using (asset, "date")),
  k as (select *, coalesce(o_insider, r_insider, 0) insider, coalesce(o_supply, r_supply, total) supply from j),
  p as (select *, case when cap > 0 then sqrt(cap / vol) * (1 + insider) end fb, case when cap > 0 then ln(1 + greatest(supply - circ, 0) / circ) * sqrt(cap / vol) * (1 + insider) end fu from k),
  q as (select "date", quantile_cont(o_raw, 0.01) o1, quantile_cont(o_raw, 0.99) o2, quantile_cont(r_raw, 0.01) r1, quantile_cont(r_raw, 0.99) r2, quantile_cont(fu, 0.01) u1, quantile_cont(fu, 0.99) u2, quantile_cont(fb, 0.01) b1, quantile_cont(fb, 0.99) b2 from p group by "date"),
  c as (select p.*, greatest(least(o_raw, o2), o1) oc, greatest(least(r_raw, r2), r1) rc, greatest(least(fu, u2), u1) uc, greatest(least(fb, b2), b1) bc from p join q using ("date")),
  s as (select asset, "date", unnest(['o', 'r', 'u', 'b']) layer, unnest([case when o_raw is not null then oc end, case when r_raw is not null then rc end, case when fu is not null then uc end, case when fb is not null then bc end]) v from c),
  w as (select *, case when count(*) over (partition by "date", layer) = 1 then 0.5 else (rank() over (partition by "date", layer order by v) + (count(*) over (partition by "date", layer, v) - 1) / 2.0 - 1) / (count(*) over (partition by "date", layer) - 1) end rk from s where v is not null),
  x as (select asset, "date", max(rk) filter (layer = 'o') ro, max(rk) filter (layer = 'r') rr, max(rk) filter (layer = 'u') ru, max(rk) filter (layer = 'b') rb from w group by 1, 2),
  z as (select c.*, case when oq = 'ok' then ro end xo, case when rq = 'ok' then rr end xr, ru, rb from c left join x using (asset, "date"))
"""


@query(SQL + """ select asset, "date", round(o_raw, 9) raw_observed, round(r_raw, 9) raw_reconstructed, round(fu, 6) raw_proxy_full, round(fb, 6) raw_proxy_fallback, round(insider, 6)::double insider,
  case when o_insider is not null then 'observed' when r_insider is not null then 'reconstructed' else 'missing_zeroed' end insider_mode, supply::double supply,
  case when supply = o_supply then 'observed_supply' when supply = r_supply then 'reconstructed_supply' when supply is not null and total is not null then 'market_supply' else 'market_chart_circ_approx' end supply_mode, round(unknown, 6)::double unknown,
  case when oq = 'review_required' then oq when o_raw is not null then oq when r_raw is not null then rq when fu is not null then 'proxy_full' when fb is not null then 'proxy_fallback' else oq end quality,
  case when seen then 'observed' when cdate is not null then 'captured' when fu is not null then 'proxy_full' when fb is not null then 'proxy_fallback' end "source", round(conf, 6) confidence,
  case when seen then 0 when cdate is not null then date_diff('day', cdate - 5, "date") end::int lag_days, round(coalesce(xo, xr, ru, rb), 6) "rank",
  case when xo is not null then 'OBSERVED' when xr is not null then 'RECONSTRUCTED' when ru is not null then 'PROXY_FULL' when rb is not null then 'PROXY_FALLBACK' else 'MISSING' end state from z""")
def unlock_layers(spark, sf):
    """Every asset and month with its layers, where each field comes from, and the rank that counts."""
    rounds = {"raw_observed": 9, "raw_reconstructed": 9, "raw_proxy_full": 6, "raw_proxy_fallback": 6, "insider": 6, "unknown": 6, "confidence": 6, "rank": 6}
    rows = _assembled(spark, sf)
    return rows.withColumns({c: F.round(c, n) for c, n in rounds.items()}).drop("rank_observed", "rank_reconstructed", "rank_proxy_full", "rank_proxy_fallback")


@query(SQL + """ select state, quality, count(*) n_rows, count(distinct asset) n_assets from (select asset, case when oq = 'review_required' then oq when o_raw is not null then oq when r_raw is not null then rq when fu is not null then 'proxy_full' when fb is not null then 'proxy_fallback' else oq end quality,
  case when xo is not null then 'OBSERVED' when xr is not null then 'RECONSTRUCTED' when ru is not null then 'PROXY_FULL' when rb is not null then 'PROXY_FALLBACK' else 'MISSING' end state from z) group by all""")
def layer_quality_ladder(spark, sf):
    """Rows and assets by the layer that counts and its quality."""
    return _assembled(spark, sf).groupBy("state", "quality").agg(F.count("*").alias("n_rows"), F.countDistinct("asset").alias("n_assets"))
