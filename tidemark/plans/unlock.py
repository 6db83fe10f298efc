"""Unlock features, payload parsing, upserts and lookups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import unlocks, windows
from tidemark.plans.register import registry
from tidemark.sources.views import AS_OF, UNLOCKS, keep_last, table, unlock_as_of, unlock_events

query, QUERIES, ORACLES = registry()
R = lambda c, name, n=6: F.round(c, n).alias(name)
BUCKET = """case when lbl in ('team', 'founder', 'founders', 'founder / team', 'founders / team', 'core contributors', 'contributors', 'contributor sale', 'advisors', 'advisor', 'employee', 'employees') then 'Team/Founders'
  when lbl in ('private investors', 'public investors', 'investor', 'investors', 'backers', 'seed', 'seed sale', 'private sale', 'strategic sale', 'strategic') then 'VC/Investors'
  when lbl in ('public sale', 'ido', 'ieo', 'ico', 'launchpool', 'launchpad', 'community', 'airdrop', 'testnet incentive', 'liquidity mining') then 'Airdrop/Public'
  when lbl in ('treasury', 'foundation', 'ecosystem', 'rewards', 'reward', 'reserve', 'reserved', 'grants', 'grant', 'incentives') then 'Ecosystem'
  when regexp_matches(lbl, 'team|founder|advisor|contributor|employee') then 'Team/Founders'
  when regexp_matches(lbl, 'investor|backer|private|seed|strategic|series|ico|ieo|launchpad|launchpool') then case when contains(lbl, 'public') then 'Airdrop/Public' else 'VC/Investors' end
  when regexp_matches(lbl, 'foundation|treasury|ecosystem|reserve|grant|incentive') then 'Ecosystem'
  when regexp_matches(lbl, 'airdrop|community|public|testnet|reward|liquidity mining') then 'Airdrop/Public' else 'Other' end"""
U = f"with {UNLOCKS}, {AS_OF}, b as (select *, {BUCKET.replace('lbl', 'raw_label')} bucket from unlocks), w as (select *, case bucket when 'Team/Founders' then 1.5 when 'VC/Investors' then 1.2 when 'Ecosystem' then 0.8 when 'Airdrop/Public' then 0.6 end::double weight from b)"
UPS = U + ", ups as (select a.asset, a.as_of, any_value(circ) circ, coalesce(sum(weight * tokens), 0) / any_value(circ) ups from as_of a left join w on w.asset = a.asset and event_date > as_of and event_date <= as_of + 30 group by 1, 2)"


@query(UPS + " select asset, as_of, round(ups, 9) ups_raw from ups")
def ups_30d_interval(spark, sf):
    return unlocks.pressure(unlock_as_of(spark, sf), unlock_events(spark, sf)).select("asset", "as_of", R(F.col("ups_raw"), "ups_raw", 9))


SHARE = ", sh as (select asset, coalesce(sum(tokens) filter (bucket in ('Team/Founders', 'VC/Investors')), 0) / sum(tokens) filter (bucket <> 'Other') share, coalesce(sum(tokens) filter (bucket = 'Other'), 0) / sum(tokens) unknown from b group by asset)"


@query(U + SHARE + " select asset, round(share, 6) insider_share from sh")
def insider_share(spark, sf):
    return unlocks.insider_share(unlock_events(spark, sf)).select("asset", R(F.col("insider_share"), "insider_share"))


@query(U + SHARE + " select asset, round(unknown, 6) unknown_ratio from sh")
def unknown_ratio(spark, sf):
    return unlocks.insider_share(unlock_events(spark, sf)).select("asset", R(F.col("unknown_ratio"), "unknown_ratio"))


@query("""select s_suppkey k, round(ln(1 + greatest(s_acctbal, 0) / 1000.0::double) * sqrt((20000 + s_acctbal) / (1000.0::double + s_suppkey)) * (1 + (s_suppkey % 10) / 10.0::double), 6) proxy_full from supplier""")
def proxy_full(spark, sf):
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    value = unlocks.proxy_full(1000 + F.greatest(bal, F.lit(0.0)), F.lit(1000.0), 20000 + bal, 1000.0 + k, (k % 10) / 10)
    return table(spark, sf, "supplier").select(k.alias("k"), R(value, "proxy_full"))


@query("""select s_suppkey k, round(sqrt((20000 + s_acctbal) / (1000.0::double + s_suppkey)) * (1 + (s_suppkey % 10) / 10.0::double), 6) proxy_fallback from supplier""")
def proxy_fallback(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("k"), R(unlocks.proxy_fallback(20000 + F.col("s_acctbal"), 1000.0 + k, (k % 10) / 10), "proxy_fallback"))


RANK = UPS + ", r as (select *, rank() over (partition by as_of order by ups) + (count(*) over (partition by as_of, ups) - 1) / 2.0::double k, count(*) over (partition by as_of) n from ups)"


@query(RANK + " select asset, as_of, round(case when n = 1 then 0.5 else (k - 1) / (n - 1) end, 6) ups_rank from r")
def xs_percent_rank_avg(spark, sf):
    ups = unlocks.pressure(unlock_as_of(spark, sf), unlock_events(spark, sf))
    return ups.select("asset", "as_of", R(windows.percent_rank_average(F.col("ups_raw"), ["as_of"]), "ups_rank"))


@query(UPS + """, q as (select as_of, quantile_cont(ups, 0.05) lo, quantile_cont(ups, 0.95) hi from ups group by as_of) select asset, as_of, round(greatest(least(ups, hi), lo), 9) ups_clipped from ups join q using (as_of)""")
def xs_winsorize(spark, sf):
    ups = unlocks.pressure(unlock_as_of(spark, sf), unlock_events(spark, sf))
    return ups.select("asset", "as_of", R(windows.winsorize(F.col("ups_raw"), ["as_of"], 0.05, 0.95), "ups_clipped", 9))


@query("""select s_suppkey k, case when s_suppkey % 7 = 0 then 'OBSERVED' when s_suppkey % 5 = 0 then 'RECONSTRUCTED' when s_suppkey % 3 = 0 then 'PROXY_FULL' when s_suppkey % 2 = 0 then 'PROXY_FALLBACK' else 'MISSING' end state from supplier""")
def unlock_state_ladder(spark, sf):
    k = F.col("s_suppkey")
    have = lambda m: F.when(k % m == 0, 1.0)
    return table(spark, sf, "supplier").select(k.alias("k"), unlocks.state(have(7), have(5), have(3), have(2)).alias("state"))


@query(UPS + """, t as (select as_of, ups, count(*) n from ups group by 1, 2), q as (select as_of, max(n) top, sum(n) all_n from t group by as_of)
  select as_of, count(*) n_assets, round(avg((ups = 0)::int), 6) zero_fraction, round(any_value(top) / any_value(all_n), 6) max_tie_share, round(quantile_cont(ups, 0.5), 6) median from ups join q using (as_of) group by as_of""")
def unlock_quality_daily(spark, sf):
    ups = unlocks.pressure(unlock_as_of(spark, sf), unlock_events(spark, sf))
    ties = ups.groupBy("as_of", "ups_raw").agg(F.count("*").alias("n")).groupBy("as_of").agg((F.max("n") / F.sum("n")).alias("tie"))
    one = ups.groupBy("as_of").agg(F.count("*").alias("n_assets"), R(F.avg((F.col("ups_raw") == 0).cast("int")), "zero_fraction"), R(F.percentile("ups_raw", F.lit(0.5)), "median"))
    return one.join(ties, "as_of").select("as_of", "n_assets", "zero_fraction", R(F.col("tie"), "max_tie_share"), "median")


LABELS = ["Core_Contributors", "seed-sale", "Public  Investors", "ICO", "Launchpad", "Backers", "Series A", "Public seed round", "Grants", "Incentives", "Community", "community rewards", "Testnet", "Liquidity-Mining", "Rewards", "TEAM fund", "mystery", ""]


@query(f"""with l as (select s_suppkey k, ({LABELS})[s_suppkey % {len(LABELS)} + 1] raw_label from supplier), c as (select *, trim(regexp_replace(lower(raw_label), '[_\\-\\s]+', ' ', 'g')) x from l) select k, raw_label, {BUCKET.replace('lbl', 'x')} bucket from c""")
def bucket_normalize(spark, sf):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("s_suppkey") % len(LABELS) + 1).cast("int"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), label.alias("raw_label")).withColumn("bucket", text.bucket(F.col("raw_label")))


#: Forms in which an order's date is written; the last two are no dates.
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'10:00:00'Z'", "'31/02/'yyyy", "'soon'")


@query(f"""select o_orderkey k, case when o_orderkey % 8 in (4, 5) then null when o_orderkey % 8 = 7 then cast(cast(o_orderdate as date) + interval 20 year as date) else cast(o_orderdate as date) end "day" from orders""")
def date_parse(spark, sf):
    """Dates of orders, written in eight ways and read back: two are no dates, one is in seconds, one in milliseconds and twenty years on."""
    day = F.to_timestamp("o_orderdate")
    seconds = F.unix_timestamp(day)
    forms = [F.date_format(day, f) for f in DATES] + [seconds.cast("string"), (F.unix_timestamp(F.add_months(day, 240)) * 1000).cast("string")]
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.parse_date(raw).alias("day"))


@query("""select event_type, count(*) n, sum(cast(json_extract(props, '$.k') as bigint)) k_sum, max(cast(json_extract(props, '$.k') as bigint)) k_max from events group by event_type""")
def json_explode_schedule(spark, sf):
    k = F.from_json("props", "map<string,bigint>")
    rows = table(spark, sf, "events").select("event_type", F.explode_outer(k).alias("name", "k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query("""select event_id, unnest(regexp_extract_all(props, '"(\\w+)"', 1)) field, unnest(regexp_extract_all(props, ': (\\d+)', 1)) amount from events""")
def text_rows_extract(spark, sf):
    rows = F.arrays_zip(F.regexp_extract_all("props", F.lit(r'"(\w+)"'), F.lit(1)).alias("field"), F.regexp_extract_all("props", F.lit(r": (\d+)"), F.lit(1)).alias("amount"))
    return table(spark, sf, "events").select("event_id", F.explode(rows).alias("r")).select("event_id", "r.field", "r.amount")


@query("""select o_orderkey k, sha256(concat_ws('|', o_orderstatus, cast(o_orderkey as varchar), cast(o_custkey as varchar))) fingerprint from orders""")
def sha256_fingerprint(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.fingerprint(F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")).alias("fingerprint"))


@query("""select s_suppkey k, t table_no, r row_no, case when t = 0 and r = 0 then 'Date|Label' when t = 0 then '2024-01-15|' || s_name else cast(s_nationkey as varchar) || '|b' end cells
  from supplier, (values (0, 0), (0, 1), (1, 0)) v(t, r)""")
def html_table_rows(spark, sf):
    html = F.concat(F.lit("<table><tr><th>Date</th><th>Label</th></tr><tr><td>2024-01-15</td><td> "), "s_name", F.lit("</td></tr></table><p>x</p><table><tr><td>"), "s_nationkey", F.lit("</td><td>b</td></tr></table>"))
    rows = F.explode(text.table_rows(html))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), rows.alias("r")).select("k", "r.table_no", "r.row_no", F.array_join("r.cells", "|").alias("cells"))


@query("""select upper(c_mktsegment) symbol, min(c_name) id from customer group by 1""")
def id_lookup_min(spark, sf):
    return table(spark, sf, "customer").groupBy(F.upper("c_mktsegment").alias("symbol")).agg(F.min("c_name").alias("id"))


@query("""select event_id from events where upper(event_type) = 'CLICK' or list_contains(['{"k": 7}', '{"k": 8}'], lower(props))""")
def payload_match_filter(spark, sf):
    hit = (F.upper("event_type") == "CLICK") | F.array_contains(F.array(F.lit('{"k": 7}'), F.lit('{"k": 8}')), F.lower("props"))
    return table(spark, sf, "events").where(hit).select("event_id")


@query("""select user_id, arg_max(value, row(cast(ts as date), case when event_type in ('click', 'view') then 1 else 0 end, ts)) best from events where cast(ts as date) <= date '2024-01-15' group by user_id""")
def capture_as_of(spark, sf):
    mime = F.when(F.col("event_type").isin("click", "view"), "text/HTML; charset=utf-8").otherwise("application/json")
    rows = table(spark, sf, "events").select("user_id", "ts", mime.alias("mime"), F.col("value").alias("best"))
    return unlocks.best_capture(rows, "user_id", "ts", "mime", F.lit("2024-01-15").cast("date")).select("user_id", "best")


@query("""with old as (select c_custkey k, 'a' tag, 1 first_seen from customer where c_custkey % 2 = 0), new as (select c_custkey k, 'b' tag, 2 first_seen from customer where c_custkey % 3 = 0)
  select coalesce(old.k, new.k) k, coalesce(new.tag, old.tag) tag, coalesce(old.first_seen, new.first_seen) first_seen, case when new.k is not null then 2 else 1 end last_seen from old full join new on old.k = new.k""")
def source_upsert_first_seen(spark, sf):
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    old = k.where("k % 2 = 0").select("k", F.lit("a").alias("tag"), F.lit(1).alias("seen"))
    new = k.where("k % 3 = 0").select("k", F.lit("b").alias("tag"), F.lit(2).alias("seen"))
    both = old.union(new).groupBy("k").agg(F.max_by("tag", "seen").alias("tag"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return both


@query("""select s_suppkey k, s_acctbal v from supplier where s_suppkey % 4 <> 0 union all select s_suppkey, -1.0 from supplier where s_suppkey % 8 = 0""")
def replace_partition_rows(spark, sf):
    """Rows of the replaced groups go, the new rows come."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    gone = s.where("k % 4 = 0").select((F.col("k") % 4).alias("g")).distinct()
    return s.join(gone, s.k % 4 == gone.g, "left_anti").unionByName(s.where("k % 8 = 0").select("k", F.lit(-1.0).alias("v")))
