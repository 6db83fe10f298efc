"""The grid of policies over all trades, with selection on held-out and later days."""

from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators.grid import Policy
from tidemark.plans.register import registry
from tidemark.sources.views import TRADES, trades

query, QUERIES, ORACLES = registry()
POLICIES = [
    Policy("current_065", 0.65),
    Policy("fixed_075", 0.75, "fixed"),
    Policy("fixed_080", 0.80, "fixed"),
    Policy("conservative_080", 0.80, "conservative"),
    Policy("fixed_080_cooldown3", 0.80, "fixed", cooldown=3),
    Policy("fixed_075_top1", 0.75, "fixed", top_n=1),
    Policy("fixed_080_regime55", 0.80, "fixed", regime_min=0.55),
    Policy("fixed_080_cap2", 0.80, "fixed", daily_cap=0.02),
]
BENCHMARK = "fixed_080"
SQL = f"with recursive {TRADES}" + """, days as (select list(distinct "date" order by "date") d from trades), s0 as (select d, len(d) n, least(greatest(cast(floor(len(d) * 0.2) as int), 90), greatest(len(d) - 252, 90)) h, greatest(cast(floor(len(d) * 0.1) as int), 90) b from days),
  s1 as (select *, least(4, greatest((n - 252) // b, 0)) c from s0),
  spans as (
    select 'all' span, d[1] a, d[n] z from s1 where n > 0 union all select 'holdout_train', d[1], d[n - h] from s1 where n >= 320 and n - h >= 252 union all select 'holdout_test', d[n - h + 1], d[n] from s1 where n >= 320 and n - h >= 252
    union all select 'fold_' || (k + 1) || '_train', d[1], d[n - c * b + k * b] from s1, (select unnest(range(4)) k) where n >= 400 and k < c union all select 'fold_' || (k + 1) || '_test', d[n - c * b + k * b + 1], d[n - c * b + k * b + b] from s1, (select unnest(range(4)) k) where n >= 400 and k < c),
  p(label, thr, size, most, reg, cool) as (values ('current_065', 0.65::double, 'current', null, null, 0), ('fixed_075', 0.75, 'fixed', null, null, 0), ('fixed_080', 0.8, 'fixed', null, null, 0), ('conservative_080', 0.8, 'conservative', null, null, 0),
    ('fixed_080_cooldown3', 0.8, 'fixed', null, null, 3), ('fixed_075_top1', 0.75, 'fixed', 1, null, 0), ('fixed_080_regime55', 0.8, 'fixed', null, 0.55, 0), ('fixed_080_cap2', 0.8, 'fixed', 2, null, 0)),
  el as (select p.*, t.* from p join trades t on t.score > p.thr and (p.reg is null or t.regime >= p.reg)),
  cq as (select symbol, row_id, date_diff('day', date '1970-01-01', "date") d, row_number() over (partition by symbol order by "date", score desc, row_id) k from el where cool > 0),
  f(symbol, k, last, kept, row_id) as (select symbol, k, d, true, row_id from cq where k = 1 union all
    select cq.symbol, cq.k, case when cq.d - f.last > 3 then cq.d else f.last end, cq.d - f.last > 3, cq.row_id from f join cq on cq.symbol = f.symbol and cq.k = f.k + 1),
  e2 as (select * from el where cool = 0 or row_id in (select row_id from f where kept)),
  e3 as (select *, row_number() over (partition by label, "date" order by score desc, row_id) rk from e2),
  tr as (select label, "date", symbol, row_id, pnl, greatest(least(case size when 'current' then "position" when 'fixed' then 2000.0 else least("position" * 0.5, 4000.0) end / 200000.0, 0.25), 0.0)::double alloc from e3 where most is null or rk <= most),
  r as (select span, label, "date", symbol, row_id, pnl, alloc, greatest(least(pnl, 2.0), -0.5) * alloc ret from tr join spans on "date" between a and z where alloc > 0.001),
  eq as (select *, exp(sum(ln(1 + ret)) over (partition by span, label order by "date", symbol, row_id rows between unbounded preceding and current row)) equity from r),
  dd as (select *, equity / greatest(max(equity) over (partition by span, label order by "date", symbol, row_id rows between unbounded preceding and current row), 1) - 1 fall from eq),
  g as (select span, label, count(*) n, avg(ret) / (stddev_pop(ret) + 1e-10) * sqrt(50.4) sharpe, exp(sum(ln(1 + ret))) - 1 cum, -min(fall) dd, avg((pnl > 0)::int) win, avg(alloc) alloc from dd group by 1, 2),
  m as (select s.span, p.label, coalesce(n, 0) n_active, round(case when n >= 5 then sharpe else 0 end, 6) sharpe, round(case when n >= 5 then cum else 0 end, 6) cum_return, round(case when n >= 5 then greatest(dd, 0) else 0 end, 6) max_dd, round(case when n >= 5 then win else 0 end, 6) win_rate,
    round(case when n >= 5 then alloc else 0 end, 6) avg_alloc from spans s cross join p left join g on g.span = s.span and g.label = p.label)"""


def _metrics(spark, sf):
    metrics, _ = grid.grid_metrics(trades(spark, sf), POLICIES)
    return metrics.withColumns({c: F.round(c, 6) for c in grid.METRICS[1:]})


@query(SQL + " select * from m")
def policy_grid(spark, sf):
    """All policies in all spans of days, from one pass over the trades."""
    return _metrics(spark, sf).select("span", "label", *grid.METRICS)


@query(SQL + """, o as (select *, row_number() over (partition by span order by sharpe desc, cum_return desc, max_dd, n_active desc, label) place from m),
  c as (select replace(span, '_train', '') split, label chosen, sharpe train_sharpe from o where place = 1 and span like '%!_train' escape '!')
  select c.*, t.n_active chosen_n_active, t.sharpe chosen_sharpe, t.cum_return chosen_cum_return, t.max_dd chosen_max_dd, b.n_active benchmark_n_active, b.sharpe benchmark_sharpe, b.cum_return benchmark_cum_return, b.max_dd benchmark_max_dd, chosen = 'fixed_080' matches
  from c join m t on t.span = c.split || '_test' and t.label = c.chosen join m b on b.span = c.split || '_test' and b.label = 'fixed_080'""")
def policy_selection(spark, sf):
    """The policy that was best on the days before each test, and how it did there."""
    return grid.selection(_metrics(spark, sf), BENCHMARK)


@query(SQL + " select label, row_number() over (order by sharpe desc, cum_return desc, max_dd, n_active desc, label)::int place, sharpe, cum_return, max_dd, n_active from m where span = 'all'")
def policy_order(spark, sf):
    return _metrics(spark, sf).where("span = 'all'").select("label", grid.in_order("span").alias("place"), "sharpe", "cum_return", "max_dd", "n_active")
