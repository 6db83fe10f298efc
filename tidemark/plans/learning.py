"""Models over folds and series; SQL can't express these, tests compare them with plain forms."""

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clusters, crossval, drift, importance, information, learning, policy, portfolio, regimes, walkforward
from tidemark.operators.prefix import prefix_sum
from tidemark.plans.market import _returns
from tidemark.plans.register import registry
from tidemark.sources.folders import checkpointed
from tidemark.sources.views import bars_daily, table, trades

query, QUERIES, ORACLES = registry()
FEATURES = ["score", "regime", "position"]


@query()
def fracdiff_optimal_d(spark, sf):
    return learning.optimal_d(bars_daily(spark, sf), "symbol", "ts", "close")


@query()
def isotonic_pav(spark, sf):
    df = trades(spark, sf).select("row_id", "cluster", "score", (F.col("pnl") > 0).cast("double").alias("y"))
    return learning.isotonic_by(df, "cluster", "score", "y").select("row_id", "cluster", "score", "calibrated")


def _folded(spark, sf, folds, *more):
    df = trades(spark, sf)
    tagged = df.join(policy.purged_folds(df, folds, 0.01).select("row_id", "pos", "fold"), "row_id").withColumn("y", (F.col("pnl") > 0).cast("double"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(tagged).select("row_id", "pos", "fold", "y", "features", *more)
    return checkpointed(rows)  # read once per model


def purge_span(n, folds, first, last, embargo=0.01):
    """Positions [lo, hi) that are not trained on when the folds ``first`` to ``last`` of ``n`` rows are tested."""
    size, gap = max(1, n // folds), max(1, int(n * embargo))
    return max(0, first * size - gap), min(n, (n if last == folds - 1 else (last + 1) * size) + gap)


@query()
def stack_oos(spark, sf):
    """Out-of-fold chances: the mean of boosted trees and a random forest, each fit outside the fold and its embargo."""
    df, out = _folded(spark, sf, 3), None
    n = df.count()
    for k in range(3):
        part = df.where(F.col("fold") == k)
        lo, hi = purge_span(n, 3, k, k)
        train = df.where(~F.col("pos").between(lo, hi - 1))
        for model in (GBTClassifier(labelCol="y", maxDepth=2, maxIter=5, seed=7), RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=4, seed=7)):
            p = model.fit(train).transform(part).select("row_id", "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
            out = p if out is None else out.union(p)
    return out.groupBy("row_id", "fold").agg(F.avg("p").alias("p_oos"))


@query()
def cpcv_auc(spark, sf):
    """Area under the curve on the pairs of six groups, by a logistic model fit on rows before the first and after the last of the pair.

    The rows from the embargo before the first group to that after the last, those between the two included, are not
    trained on; a pair that leaves fewer than 40 training rows is left out, as the pair of the two ends is.
    """
    df, out = _folded(spark, sf, 6), None
    n = df.count()
    for a in range(6):
        for b in range(a + 1, 6):
            lo, hi = purge_span(n, 6, a, b)
            if lo + n - hi < 40:
                continue
            held = F.col("fold").isin(a, b)
            model = LogisticRegression(labelCol="y", maxIter=10, regParam=0.01).fit(df.where(~F.col("pos").between(lo, hi - 1)))
            p = model.transform(df.where(held)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "y")
            out = p if out is None else out.union(p)
    return information.auc(out, "p", F.col("y") == 1, ["a", "b"])


def _logistic(train):
    """The chance, as a column of ``features``, by a logistic model of counted rows (features, y, _n).

    The features are scaled by their deviations over all that the rows stand for, as a model of those rows would be:
    weights alone would give slightly other ones.
    """
    at = vector_to_array("features")
    x = [F.get(at, F.lit(k)) for k in range(len(FEATURES))]
    n = F.sum("_n")
    some = train.agg(*[(F.sum(F.col("_n") * v) / F.sum("_n")).alias(f"m{k}") for k, v in enumerate(x)]).first()
    spread = train.agg(*[F.sqrt(F.sum(F.col("_n") * F.pow(v - some[f"m{k}"], 2)) / (n - 1)).alias(f"s{k}") for k, v in enumerate(x)]).first()
    scale = [spread[k] or 1.0 for k in range(len(x))]
    scaled = train.select("y", "_n", array_to_vector(F.array(*[v / s for v, s in zip(x, scale)])).alias("features"))
    model = LogisticRegression(labelCol="y", weightCol="_n", maxIter=10, regParam=0.01, standardization=False).fit(scaled)
    margin = sum((v * (c / s) for v, c, s in zip(x, model.coefficients.toArray().tolist(), scale)), F.lit(model.intercept))
    return 1 / (1 + F.exp(-margin))


@query()
def cpcv_verdict(spark, sf):
    """Areas of the 15 paths, the share of them under a half, and whether that passes."""
    rows = _folded(spark, sf, 6).drop("fold")
    return crossval.verdict(crossval.cross_predictions(rows, _logistic, alike=("features", "y"), whole=False), count="_n")


@query()
def cpcv_calibration(spark, sf):
    """Predictions of all paths calibrated by cluster, clusters of few rows by all."""
    rows = _folded(spark, sf, 6, "cluster", "date")
    rows = portfolio.weighted(rows, "date", "_weight").drop("fold", "row_id", "date")
    counted = crossval.cross_predictions(rows, _logistic, alike=("features", "y"), whole=False, by=("cluster",), weight="_weight")
    _, report = portfolio.cluster_calibrated(counted, "pos", "cluster", "p", "y", "_weight", learning.isotonic, count="_n")
    return report


@query("""with n as (select count(*) n from orders), p as (select row_number() over (order by o_orderkey) - 1 pos from orders), b as (select k, k * (n // 6) + least(k, n % 6) lo, (k + 1) * (n // 6) + least(k + 1, n % 6) hi, greatest(1, cast(floor(n * 0.01) as int)) e from n, (select unnest(range(6)) k)),
  c as (select x.k || '-' || y.k path, x.lo lo1, x.hi hi1, y.lo lo2, y.hi hi2, x.e from b x join b y on x.k < y.k),
  r as (select 'folds' purge, path, case when pos >= lo1 and pos < hi1 or pos >= lo2 and pos < hi2 then 'test' when not (pos >= lo1 - e and pos < hi1 + e or pos >= lo2 - e and pos < hi2 + e) then 'train' end role from p, c
    union all select 'span', path, case when pos >= lo1 and pos < hi1 or pos >= lo2 and pos < hi2 then 'test' when not (pos >= lo1 - e and pos < hi2 + e) then 'train' end from p, c)
  select purge, path, count(*) filter (role = 'train') n_train, count(*) filter (role = 'test') n_test from r group by 1, 2 having count(*) filter (role = 'train') >= 40""")
def cpcv_paths(spark, sf):
    """Rows that each path trains on and tests, purged around each fold or over the whole span."""
    keys = table(spark, sf, "orders").select("o_orderkey", F.lit(1).cast("long").alias("_one"))
    rows = checkpointed(prefix_sum(keys, [], [F.col("o_orderkey")], "_one", "pos").select("pos"))
    n = rows.count()
    both = [crossval.path_roles(rows, n, span=s).withColumn("purge", F.lit("span" if s else "folds")) for s in (False, True)]
    return both[0].union(both[1]).groupBy("purge", "path").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))


@query()
def robust_pca(spark, sf):
    """Two components of clipped features, scaled by median and quartiles."""
    df = trades(spark, sf)
    q = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)])).alias(c) for c in FEATURES])
    wide = df.select("row_id", *FEATURES).join(F.broadcast(q.select(*[F.col(c).alias(f"q_{c}") for c in FEATURES])))  # one row
    edge = lambda c, i: F.get(f"q_{c}", F.lit(i))
    scaled = [((F.greatest(F.least(F.col(c), edge(c, 4)), edge(c, 0)) - edge(c, 2)) / F.greatest(edge(c, 3) - edge(c, 1), F.lit(1e-9))).alias(c) for c in FEATURES]
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(wide.select("row_id", *scaled))
    pcs = vector_to_array("pc")
    return PCA(k=2, inputCol="v", outputCol="pc").fit(vectors).transform(vectors).select("row_id", F.get(pcs, F.lit(0)).alias("pc1"), F.get(pcs, F.lit(1)).alias("pc2"))


@query()
def regime_hmm(spark, sf):
    return learning.regime(_returns(spark, sf), "symbol", "ts", "r")


PANEL = ["r", "span", "volume", "n_trades"]


def _panel(spark, sf):
    """Daily bars with returns and the log of high over low."""
    bars = bars_daily(spark, sf)
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return bars.withColumn("r", F.log(F.col("close") / before)).withColumn("span", F.log(F.col("high") / F.col("low"))).select("symbol", "ts", *PANEL)


@query()
def c2st_auc(spark, sf):
    """Whether the newest 30 days of each symbol differ from the 252 before, with the chance of a block bootstrap."""
    return drift.drift_test(_panel(spark, sf), "symbol", "ts", PANEL, replicates=200)


@query()
def drift_by_feature(spark, sf):
    return drift.feature_drift(_panel(spark, sf), "symbol", "ts", PANEL)


@query()
def drift_portfolio(spark, sf):
    return drift.portfolio_drift(c2st_auc(spark, sf))


@query()
def feature_clusters(spark, sf):
    """Features of all trades that share information, by Ward linkage of their variation of information."""
    columns = ["score", "pnl", "regime", "position", "slippage", "label"]
    pairs = information.vi_matrix(information.quantile_bins(trades(spark, sf), columns, 10), [f"{c}_bin" for c in columns])
    return clusters.ward_clusters(pairs.withColumn("universe", F.lit("all")), ["universe"], 0.3)


def _nation_trades(spark, sf):
    """Trades with the customer's nation as their symbol."""
    names = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))  # 25 rows
    homes = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(names), "n_nationkey")
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("c_custkey"))
    return trades(spark, sf).drop("symbol").join(at.join(homes, "c_custkey").select("row_id", "symbol"), "row_id")


@query()
def symbol_clusters(spark, sf):
    """Nations by what their trades look like."""
    return clusters.symbol_clusters(clusters.signatures(_nation_trades(spark, sf), "symbol", [*FEATURES, "pnl"]), "symbol")


@query()
def clustered_importance(spark, sf):
    """What the groups of features are worth for telling trades of the later days that win."""
    df = trades(spark, sf).withColumn("y", (F.col("pnl") > 0).cast("int"))
    late = F.col("date") >= F.lit("1999-01-01").cast("date")
    return importance.clustered_importance(df.where(~late), df.where(late), "row_id", {1: ["score", "slippage"], 2: ["regime"], 3: ["position"]}, "y", repeats=5, within=3, trees=20)


@query()
def isotonic_walk_forward(spark, sf):
    """Daily win rates per symbol, calibrated by the days before."""
    df = trades(spark, sf).groupBy("symbol", "date").agg(F.avg("score").alias("score"), F.avg((F.col("pnl") > 0).cast("double")).alias("y"))
    return walkforward.isotonic_walk_forward(df, "symbol", "date", "score", "y")


@query()
def regime_walk_forward(spark, sf):
    return walkforward.regime_walk_forward(_returns(spark, sf), "symbol", "ts", "r")


@query()
def fracdiff_expanding_d(spark, sf):
    return walkforward.optimal_d_expanding(bars_daily(spark, sf), "symbol", "ts", "close")


@query()
def regime_components(spark, sf):
    """The chain over the components of a day's features, refit on the days before."""
    return regimes.component_regimes(_panel(spark, sf), "symbol", "ts", PANEL, "r", every=63, rounds=8)


@query()
def component_crashes(spark, sf):
    """How far the days of the worst returns lie along the first component, plain and robust."""
    panel = _panel(spark, sf)
    cut = F.broadcast(panel.groupBy("symbol").agg(F.percentile("r", F.lit(0.005)).alias("cut")))  # a row per symbol
    return regimes.component_health(panel.join(cut, "symbol").withColumn("crash", F.col("r") <= F.col("cut")), "symbol", "ts", PANEL, "crash")


@query()
def regime_validation(spark, sf):
    """How the regimes out of sample agree with what came, and whether they call a falling span one."""
    rows = regime_components(spark, sf).join(_panel(spark, sf).select("symbol", "ts", "r"), ["symbol", "ts"])
    return regimes.regime_report(rows, ["symbol"], "r", F.col("ts").between(F.lit("1995-01-01").cast("date"), F.lit("1995-06-30").cast("date")))
