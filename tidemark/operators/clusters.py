"""Ward clustering of features by shared information, and of symbols by their signatures.

What is clustered is bounded by the number of features or symbols, not of rows: rows become a matrix of distances or a
row of statistics each in Spark, and only that is linked, a group per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More items than this in a group raise; their distances would be 128 MB.
MOST = 4096


def ward(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) of the items of a square distance matrix, i < j being the smallest items of two clusters.

    Each step joins the nearest two clusters (of ties, those with the smallest items) and updates distances by the
    Lance-Williams rule for the least growth of variance.
    """
    n = len(distance)
    if n > MOST:
        raise ValueError(f"{n} items are clustered, {MOST} at most can be")
    square, size, merges = np.asarray(distance, dtype=float) ** 2, np.ones(n), []
    np.fill_diagonal(square, np.inf)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(square.argmin()), n))
        height = square[i, j]
        merges.append((i, j, float(np.sqrt(height))))
        both = size[i] + size[j] + size
        joined = ((size[i] + size) * square[i] + (size[j] + size) * square[j] - size * height) / both
        gone = np.isinf(square[i]) | np.isinf(square[j])
        joined[gone] = np.inf
        square[i], square[:, i] = joined, joined
        square[j], square[:, j] = np.inf, np.inf
        square[i, i] = np.inf
        size[i] += size[j]
    return merges


def cut(n: int, merges: list[tuple[int, int, float]], height: float | None = None, most: int | None = None) -> np.ndarray:
    """The smallest member of each item's cluster, after the merges up to ``height``, or after those that leave ``most`` clusters."""
    first = np.arange(n)
    for i, j, h in merges[: max(0, n - most)] if most is not None else merges:
        if height is None or h <= height:
            first[first == first[j]] = first[i]
    return first


def ward_clusters(pairs: DataFrame, keys: list[str], limit: float, a: str = "a", b: str = "b", distance: str = "vi") -> DataFrame:
    """(keys, feature, cluster, size, inside): clusters of the items of each group of ``pairs``, cut at ``limit``.

    Each group holds every pair of its items once, or the pair counts as 1 apart. Clusters are numbered from 1 by their
    smallest member; ``inside`` is the mean distance between their members (0 for one alone). A null distance is 1; a
    group of one pair of equal names is one item.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        items = sorted(set(frame[a]) | set(frame[b]))
        place = {x: k for k, x in enumerate(items)}
        d = np.ones((len(items), len(items)))
        i, j = frame[a].map(place).to_numpy(), frame[b].map(place).to_numpy()
        d[i, j] = d[j, i] = frame[distance].fillna(1.0).to_numpy()
        np.fill_diagonal(d, 0)
        first = cut(len(items), ward(d), height=limit)
        names = {f: k + 1 for k, f in enumerate(sorted(set(first.tolist())))}
        rows = []
        for k, x in enumerate(items):
            own = np.flatnonzero(first == first[k])
            inside = d[np.ix_(own, own)].sum() / (len(own) * (len(own) - 1)) if len(own) > 1 else 0.0
            rows.append((*frame[keys].iloc[0], x, names[first[k]], len(own), inside))
        return pd.DataFrame(rows, columns=[*keys, "feature", "cluster", "size", "inside"])

    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "feature string", "cluster int", "size int", "inside double"])
    return pairs.select(*keys, a, b, distance).groupBy(*keys).applyInPandas(run, schema)


def signatures(df: DataFrame, symbol: str, features: list[str]) -> DataFrame:
    """A row per symbol: median, spread between quartiles and share of values of each feature."""
    parts = []
    for c in features:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts += [F.get(q, F.lit(1)).alias(f"{c}_median"), (F.get(q, F.lit(2)) - F.get(q, F.lit(0))).alias(f"{c}_iqr"), F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_coverage")]
    return df.groupBy(symbol).agg(*parts)


def _filled(marks: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and non-finite values become the column's median over symbols, 0 if it has none; adds ``_middle`` and ``_spread`` per column."""
    finite: dict[str, Column] = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    clean = marks.withColumns(finite)
    middle = clean.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"_m_{c}") for c in columns])
    full = clean.join(F.broadcast(middle)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns})  # one row
    quarters = full.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in columns])
    spread = lambda c: F.get(f"_q_{c}", F.lit(2)) - F.get(f"_q_{c}", F.lit(0))
    scaled = {f"_s_{c}": (F.col(c) - F.get(f"_q_{c}", F.lit(1))) / F.when(spread(c) > 0, spread(c)).otherwise(1.0) for c in columns}
    return full.join(F.broadcast(quarters)).withColumns(scaled)  # one row


def symbol_clusters(marks: DataFrame, symbol: str, least: int = 4, most: int = 4) -> DataFrame:
    """(symbol, cluster, method) by Ward linkage of the symbols' signatures, scaled by median and quartiles.

    There are as many clusters as ``least`` symbols fit, from 2 to ``most``. Members of a cluster with fewer than
    ``least`` go to the large cluster whose mean (of unscaled values) is nearest; without a large one all are one.
    Fewer than twice ``least`` symbols, or than two columns, are one cluster. Clusters are numbered by their members'
    names in order. A null symbol is left out; an empty table gives no rows.
    """
    columns = [c for c in marks.columns if c != symbol]
    marks = marks.where(F.col(symbol).isNotNull())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(symbol, ignore_index=True)
        n, method = len(frame), "ward"
        if n < 2 or len(columns) < 2:
            first, method = np.zeros(n, dtype=int), "too_few_columns"
        elif n < 2 * least:
            first, method = np.zeros(n, dtype=int), "too_few_symbols"
        else:
            x = frame[[f"_s_{c}" for c in columns]].to_numpy(float)
            raw = frame[columns].to_numpy(float)
            distance = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
            first = cut(n, ward(distance), most=min(most, max(2, n // least)))
            means = {f: raw[first == f].mean(axis=0) for f in sorted(set(first.tolist()))}
            large = [f for f in means if (first == f).sum() >= least]
            first = np.array([f if f in large else min(large, key=lambda g: float(np.linalg.norm(raw[k] - means[g]))) if large else 0 for k, f in enumerate(first.tolist())])
        names = frame[symbol].astype(str).to_numpy()
        order = sorted(set(first.tolist()), key=lambda f: tuple(names[first == f]))
        return pd.DataFrame({symbol: frame[symbol], "cluster": [f"cluster_{order.index(f) + 1}" for f in first.tolist()], "method": method})

    kind = dict(marks.dtypes)[symbol]
    wide = _filled(marks, columns) if columns else marks
    # a row per symbol, MOST at most
    return wide.select(symbol, *columns, *[f"_s_{c}" for c in columns]).groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"{symbol} {kind}, cluster string, method string")
