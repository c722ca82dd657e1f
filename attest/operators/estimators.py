"""Estimators over long pairs: claim, x, y.  An undefined value is null, never 0."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank buckets; each holds about its share of the different values.
BUCKETS = 200


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: null under three rows and where a side is constant."""
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when((F.count(x) >= 3) & ~constant, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def average_ranks(df: DataFrame, value: str, out: str, by: str = "claim") -> DataFrame:
    """df with the 1-based rank of ``value`` within ``by``, ties averaged.

    Ranks come from counts of different values, dealt into buckets of value ranges, so neither a common value nor a
    claim with all rows is ever in one task.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = counts.groupBy(by).agg(F.percentile_approx(value, cuts, 10 * BUCKETS).alias("_bounds"))
    dealt = counts.join(F.broadcast(bounds), by).withColumn("_bucket", F.expr(f"size(filter(_bounds, b -> b < {value}))")).drop("_bounds")
    totals = dealt.groupBy(by, "_bucket").agg(F.sum("_n").alias("_total"))
    before = totals.selectExpr(by, "_bucket", f"coalesce(sum(_total) over (partition by {by} order by _bucket rows between unbounded preceding and 1 preceding), 0) as _before")
    running = f"sum(_n) over (partition by {by}, _bucket order by {value} rows between unbounded preceding and current row)"
    ranked = dealt.join(F.broadcast(before), [by, "_bucket"]).selectExpr(by, value, f"_before + {running} - _n + (_n + 1) / 2.0D as {out}")
    return df.join(ranked, [by, value])


def point_pearson(pairs: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return pairs.groupBy("claim").agg(pearson(x, y).alias("estimate"))


def point_spearman(pairs: DataFrame) -> DataFrame:
    ranked = average_ranks(average_ranks(pairs.select("claim", "x", "y"), "x", "rx"), "y", "ry")
    return ranked.groupBy("claim").agg(pearson(F.col("rx"), F.col("ry")).alias("estimate"))


def _weighted_ranks(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    values, at = np.unique(v, return_inverse=True)
    total = np.bincount(at, weights=w, minlength=len(values))
    return (np.cumsum(total) - total + (total + 1) / 2)[at]


def weighted_pearson(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float | None:
    used = w > 0
    x, y, w = x[used], y[used], w[used]
    if w.sum() < 3 or not len(x) or x.min() == x.max() or y.min() == y.max():
        return None
    x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
    return float((w * x * y).sum() / np.sqrt((w * x * x).sum() * (w * y * y).sum()))


def weighted_spearman(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float | None:
    used = w > 0
    x, y, w = x[used], y[used], w[used]
    return weighted_pearson(_weighted_ranks(x, w), _weighted_ranks(y, w), w) if len(x) else None


@dataclass(frozen=True)
class Estimator:
    name: str
    kind: str
    point: Callable[[DataFrame], DataFrame]
    #: From one replicate's weights; None where sums by unit are enough.
    weighted: Callable[[np.ndarray, np.ndarray, np.ndarray], float | None] | None = None


ESTIMATORS: dict[str, Estimator] = {
    "pearson": Estimator("pearson", "correlation", point_pearson),
    "spearman": Estimator("spearman", "correlation", point_spearman, weighted_spearman),
}


def register(estimator: Estimator) -> None:
    """Add one's own: ``point`` gives (claim, estimate), ``weighted`` one replicate's value from values and weights."""
    ESTIMATORS[estimator.name] = estimator
