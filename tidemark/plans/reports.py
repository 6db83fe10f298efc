"""Model frames and reports: fills, decay, daily counts, candidate gaps, envelope checks."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.operators import panel, windows
from tidemark.plans.market import RET, _returns
from tidemark.plans.register import registry
from tidemark.sources.views import TARGETS, TRADES, table, targets, trades

query, QUERIES, ORACLES = registry()
R = lambda c, name, n=6: F.round(c, n).alias(name)
T = f"with {TRADES} "


def filled(x: Column, window, neutral: float = 0.0) -> Column:
    """``x`` with infinities and nulls replaced by the last value before them in ``window``, else by ``neutral``."""
    finite = F.when(F.abs(x) != float("inf"), x)
    return F.coalesce(F.last(finite, ignorenulls=True).over(window), F.lit(neutral))


@query(T + """, r as (select symbol, "date", row_id, case when row_id % 5 = 0 or row_id % 7 = 0 then null else pnl end x from trades)
  select row_id, round(coalesce(last_value(x ignore nulls) over (partition by symbol order by "date", row_id rows between unbounded preceding and current row), 0), 6) filled from r""")
def fill_model_frame(spark, sf):
    raw = F.when(F.col("row_id") % 5 == 0, None).when(F.col("row_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("pnl"))
    w = Window.partitionBy("symbol").orderBy("date", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return trades(spark, sf).select("row_id", R(filled(raw, w), "filled"))


@query(f"{RET} select symbol, ts, (r > 0)::int target from ret")
def regime_target(spark, sf):
    """1 after a gain, 0 after none; the first bar has no target."""
    return _returns(spark, sf).select("symbol", "ts", (F.col("r") > 0).cast("int").alias("target"))


@query(T + """, m as (select max("date") z from trades) select row_id, round(greatest(exp(-date_diff('day', "date", z) / 180.0::double), 1e-6), 8) weight from trades, m""")
def time_decay_weights(spark, sf):
    df = trades(spark, sf).select("row_id", "date")
    last = F.broadcast(df.agg(F.max("date").alias("z")))  # one row
    return df.join(last).select("row_id", R(F.greatest(F.exp(-F.datediff("z", "date") / F.lit(180.0)), F.lit(1e-6)), "weight", 8))


@query("""with recursive p as (select (p_partkey % 19 + 1) * 0.05::double d, count(*) parts from part group by 1), w as (select d, 0 k, 1.0::double w from p union all select d, k + 1, -w * (d - k) / (k + 1) from w where abs(w * (d - k) / (k + 1)) >= 1e-4 and k < 9999),
  v as (select d, 0 k, 1.0::double w from p union all select d, k + 1, -w * (d - k) / (k + 1) from v where k < 9)
  select round(d, 2) d, parts, n, round(total, 6) total, round(highest, 6) highest, round(lowest, 9) lowest, round(window_total, 6) window_total
  from p join (select d, count(*) n, sum(abs(w)) total, max(abs(w)) highest, min(abs(w)) lowest from w group by d) using (d) join (select d, sum(abs(w)) window_total from v group by d) using (d)""")
def fracdiff_weights_summary(spark, sf):
    """Sizes of the weights of fractional differencing, by the orders that parts name: down to 1e-4, and of a window of ten."""
    orders = table(spark, sf, "part").groupBy(((F.col("p_partkey") % 19 + 1) * F.lit(0.05)).alias("d")).agg(F.count("*").alias("parts"))
    s, first = windows.weights_summary(F.col("d"), 1e-4), windows.window_weights(F.col("d"), 10)
    rows = orders.select(R(F.col("d"), "d", 2), "parts", s.alias("s"), F.aggregate(first, F.lit(0.0), lambda a, w: a + F.abs(w)).alias("window"))
    return rows.select("d", "parts", "s.n", R(F.col("s.total"), "total"), R(F.col("s.highest"), "highest"), R(F.col("s.lowest"), "lowest", 9), R(F.col("window"), "window_total"))


@query(T + """select "date", count(*) filter (score > 0.6) n_active, count(distinct symbol) filter (score > 0.6) n_symbols from trades group by "date\"""")
def active_per_date(spark, sf):
    active = F.when(F.col("score") > 0.6, F.col("symbol"))
    return trades(spark, sf).groupBy("date").agg(F.count(active).alias("n_active"), F.countDistinct(active).alias("n_symbols"))


@query(T + """, s as (select symbol, arg_max(score, row("date", row_id)) score from trades group by symbol), k as (select *, row_number() over (order by score desc, symbol) k from s)
  select max(symbol) filter (k = 1) symbol, round(max(score) filter (k = 1), 6) top_score, round(max(score) filter (k = 1) - max(score) filter (k = 2), 6) gap from k""")
def top_candidate_gap(spark, sf):
    """The best of the symbols' latest scores and its lead over the second (null if there is none)."""
    latest = panel.latest(trades(spark, sf).select("symbol", "score", "date", "row_id"), "symbol", F.struct("date", "row_id"))
    two = latest.orderBy(F.desc("score"), "symbol").limit(2)
    lead = F.when(F.count("*") > 1, F.max("score") - F.min("score"))
    return two.agg(F.min_by("symbol", F.struct(-F.col("score"), "symbol")).alias("symbol"), R(F.max("score"), "top_score"), R(lead, "gap"))


@query(f"with {TARGETS}" + """ select arrival, concat_ws(',', case when arrival % 11 = 0 then 'portfolio' end, case when arrival % 5 = 0 then 'revision' end, case when arrival % 3 = 0 then 'fingerprint' end) mismatches
  from targets where arrival % 11 = 0 or arrival % 5 = 0 or arrival % 3 = 0""")
def envelope_mismatches(spark, sf):
    """Fields in which an envelope differs from its payload, for messages that have any."""
    a = F.col("arrival")
    envelope = {"portfolio": F.when(a % 11 == 0, "?").otherwise(F.col("portfolio")), "revision": F.col("revision") + F.when(a % 5 == 0, 1).otherwise(0), "fingerprint": F.col("fingerprint") + F.when(a % 3 == 0, 1).otherwise(0)}
    named = F.concat_ws(",", *[F.when(~v.eqNullSafe(F.col(k)), k) for k, v in envelope.items()])
    return targets(spark, sf).select("arrival", named.alias("mismatches")).where("mismatches <> ''")
