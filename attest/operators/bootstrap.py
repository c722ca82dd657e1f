"""Cluster-bootstrap intervals from sums by unit.

A replicate draws as many units as there are, with repeats.  Its correlation needs only each unit's sums, weighted by
how often the unit was drawn, so rows are read once and only units meet replicates.  Draws come from

* ``mt19937``: Python's generator on the driver, in order of the units' first rows; refused beyond ``DRIVER_DRAWS``;
* ``hash``: MD5 of seed, replicate and draw, on the executors; every SQL engine gets the same.  Up to ``SENT_UNITS`` units'
  sums go to the draws, and beyond that the draws, one row each, go to the sums;
* ``poisson``: a weight for each unit and replicate made where the unit's sums are, from an MD5 of seed and unit, so nothing
  but a replicate's sums moves.  The numbers differ from the others', so the mode is a result column.

``auto`` is ``hash`` up to ``HASH_UNITS`` units, and ``poisson`` for more.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AttestError
from ..session import small_table
from .durable import settled
from .estimators import Estimator

REPLICATES, SEED, LEVEL = 2000, 20260815, 0.95
HASH_UNITS = 10_000
#: Rows of units' sums that every executor may get (about 200 bytes each).
SENT_UNITS = 200_000
#: Draws that a task hashes, on average.
TASK_DRAWS = 500_000
DRIVER_DRAWS = 20_000_000
#: Rows that a re-ranking estimator may send to every executor (16 bytes each).
SENT_ROWS = 2_000_000
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def moments(pairs: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """claim, unit, first row, least and greatest x and y, and sums of centred x and y, one row per claim and unit.

    Units are hashed after a partial sum in each task, so a unit with most rows is no hot key.  Where a pair's unit is
    null each row is a unit of its own, and nothing is shuffled.  means: (claim, mean_x, mean_y), if known.
    """
    if means is None:
        means = pairs.groupBy("claim").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    centred = pairs.join(F.broadcast(means), "claim").withColumns({"_x": F.col("x") - F.col("mean_x"), "_y": F.col("y") - F.col("mean_y")})
    x, y = F.col("_x"), F.col("_y")
    products = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    ends = {f"{name}_{c}": (f, F.col(c)) for name, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")}
    grouped = (
        centred.filter("unit is not null")
        .groupBy("claim", "unit")
        .agg(
            F.min("row").alias("row"),
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.sum(c).alias(k) for k, c in products.items()],
            *[f(c).alias(k) for k, (f, c) in ends.items()],
        )
    )
    alone = centred.filter("unit is null").select(
        "claim", F.col("row").cast("string").alias("unit"), "row", F.lit(1.0).alias("n"), *[c.alias(k) for k, c in products.items()], *[c.alias(k) for k, (_, c) in ends.items()]
    )
    return grouped.unionByName(alone)


def hash_draws(spark: SparkSession, sizes: Iterable[int], replicates: int, seed: int) -> DataFrame:
    """g, rep, u, one row for each draw from g units.  Claims of as many units have the same draws; slices of them are dealt out."""
    sizes = sorted(set(sizes))
    slices = [(g, at, min(at + TASK_DRAWS, g * replicates) - 1) for g in sizes for at in range(0, g * replicates, TASK_DRAWS)]
    tasks = math.ceil(sum(sizes) * replicates / TASK_DRAWS)
    dealt = small_table(spark, slices, "g long, first long, last long")
    dealt = dealt.repartition(tasks) if tasks > 1 else dealt
    drawn = dealt.select("g", F.explode(F.sequence("first", "last")).alias("at")).selectExpr("g", "cast(at div g as int) as rep", "at % g as k")
    text = F.concat_ws(":", F.lit(str(seed)), "rep", "k")
    # Twelve hex digits stay below 2^53, so the remainder is exact in any engine.
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % F.col("g")
    return drawn.select("g", "rep", u.alias("u"))


def mt19937_draws(spark: SparkSession, sizes: dict[int, int], replicates: int, seed: int) -> DataFrame:
    """claim, rep, u, w, drawn on the driver, each claim from a fresh generator."""
    if sum(sizes.values()) * replicates > DRIVER_DRAWS:
        raise AttestError(f"mt19937 draws on the driver, which is kept below {DRIVER_DRAWS} draws; use the hash mode")
    rows = []
    for claim, g in sizes.items():
        rng, among = random.Random(seed), range(g)
        for rep in range(replicates):
            rows += [(claim, rep, u, float(w)) for u, w in Counter(rng.choice(among) for _ in among).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["claim", "rep", "u", "w"]), "claim int, rep int, u long, w double")


#: A prime below 2**31, so that products stay within 63 bits in any engine.
PRIME = (1 << 31) - 1


def poisson_steps() -> list[int]:
    """Where a number that is even below PRIME becomes one more of a Poisson(1) weight."""
    steps, below, p = [], 0.0, math.exp(-1)
    for k in range(1, 13):
        below += p
        p /= k
        steps.append(math.ceil(below * PRIME))
    return [x for x in steps if x < PRIME]


def poisson_weights(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """units, once per replicate that draws them, with rep and w: a Poisson(1) weight by inversion.

    A unit's MD5 gives two numbers a and b, and a + b rep modulo PRIME is its number in replicate rep.  So units are
    independent, any two replicates of a unit are too, a unit is hashed once, and every SQL engine gets the same.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "unit").cast("binary"))
    a, b = (F.conv(F.substring("_d", at, 8), 16, 10).cast("long") % PRIME for at in (1, 9))
    hashed = units.withColumn("_d", digest).withColumns({"_a": a, "_b": b}).drop("_d")
    drawn = hashed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    v = (F.col("_a") + F.col("_b") * F.col("rep")) % PRIME
    weight = F.lit(0)
    for step in poisson_steps():
        weight = weight + (v >= step).cast("int")
    return drawn.withColumn("w", weight.cast("double")).drop("_a", "_b").filter("w > 0")


def _indexed(units: DataFrame, order: str, most: int) -> DataFrame:
    """Units by number from 0.  If a claim has more than HASH_UNITS, ranges of units are numbered apart, each from the count before it."""
    if most <= HASH_UNITS:
        return units.withColumn("u", F.expr(f"cast(row_number() over (partition by claim order by {order}) - 1 as long)"))
    dealt = settled(units.repartitionByRange("claim", order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("claim", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.selectExpr("claim", "_range", "coalesce(sum(_n) over (partition by claim order by _range rows between unbounded preceding and 1 preceding), 0) as _before")
    number = f"_before + row_number() over (partition by claim, _range order by {order}) - 1"
    return dealt.join(F.broadcast(before), ["claim", "_range"]).withColumn("u", F.expr(number)).drop("_range", "_before")


def _hashed(units: DataFrame, info: DataFrame, sizes: dict[int, int], replicates: int, seed: int) -> DataFrame:
    """units, once per draw, with rep and a w of 1."""
    numbered = _indexed(units, "unit", max(sizes.values())).join(F.broadcast(info.select("claim", "g")), "claim")
    draws = hash_draws(units.sparkSession, sizes.values(), replicates, seed)
    # Spark takes draws for as few as their slices, so it is told which side to send, or to send neither.
    sums = F.broadcast(numbered) if sum(sizes.values()) <= SENT_UNITS else numbered.hint("merge")
    return draws.join(sums, ["g", "u"]).withColumn("w", F.lit(1.0))


def _from_sums(weighted: DataFrame) -> DataFrame:
    """claim, rep, r of rows with sums and w."""
    sums = weighted.groupBy("claim", "rep").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in _SUMS], *[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in ("lo_x", "hi_x", "lo_y", "hi_y")]
    )
    sxx, syy, sxy = (f"(n * {c} - {d})" for c, d in (("sxx", "sx * sx"), ("syy", "sy * sy"), ("sxy", "sx * sy")))
    r = f"case when n >= 3 and lo_x < hi_x and lo_y < hi_y then try_divide({sxy}, sqrt(greatest({sxx}, 0D) * greatest({syy}, 0D))) end"
    return sums.selectExpr("claim", "rep", f"{r} as r")


def replicates_of(
    pairs: DataFrame, estimator: Estimator, mode: str = "auto", replicates: int = REPLICATES, seed: int = SEED, means: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(claim, rep, r) of pairs(claim, x, y, unit, row), and (claim, g, mode)."""
    spark = pairs.sparkSession
    units = settled(moments(pairs, means))
    sizes = {r.claim: r.g for r in units.groupBy("claim").agg(F.count(F.lit(1)).alias("g")).collect()}  # one row a claim
    modes = {c: mode if mode != "auto" else "hash" if g <= HASH_UNITS else "poisson" for c, g in sizes.items()}
    info = small_table(spark, [(c, sizes[c], modes[c]) for c in sorted(sizes)], "claim int, g long, mode string")
    by_sums, by_rows = [], []
    for m in sorted(set(modes.values())):
        mine = {c: sizes[c] for c in modes if modes[c] == m}
        some = units.filter(F.col("claim").isin(list(mine)))
        if m == "poisson":
            weights = poisson_weights(some, replicates, seed)
        elif m == "hash":
            weights = _hashed(some, info, mine, replicates, seed)
        else:
            numbered = _indexed(some, "row", max(mine.values()))
            weights = mt19937_draws(spark, mine, replicates, seed).join(F.broadcast(numbered), ["claim", "u"])  # units below the driver's limit
        if estimator.weighted is None:
            by_sums.append(_from_sums(weights))
        else:
            weights = weights.groupBy("claim", "rep", "unit").agg(F.sum("w").alias("w")) if m == "hash" else weights.select("claim", "rep", "unit", "w")
            by_rows.append(_from_rows(pairs.filter(F.col("claim").isin(list(mine))), weights, estimator))
    parts = by_sums + by_rows
    if not parts:
        return small_table(spark, [], "claim int, rep int, r double"), info
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, info


def _from_rows(pairs: DataFrame, weights: DataFrame, estimator: Estimator) -> DataFrame:
    """Replicates of an estimator that no sums determine: pairs go to every executor, replicates are dealt out."""
    n = pairs.count()
    if n > SENT_ROWS:
        raise AttestError(f"{estimator.name} intervals need all {n} pairs on each executor; the limit is {SENT_ROWS}")
    rows = pairs.select("claim", "x", "y", F.coalesce("unit", F.col("row").cast("string")).alias("unit")).toPandas()
    held = pairs.sparkSession.sparkContext.broadcast({c: (p["x"].to_numpy(), p["y"].to_numpy(), p["unit"].to_numpy()) for c, p in rows.groupby("claim")})

    def of(key: tuple, drawn: pd.DataFrame) -> pd.DataFrame:
        x, y, unit = held.value[key[0]]
        w = pd.Series(unit).map(dict(zip(drawn["unit"], drawn["w"]))).fillna(0).to_numpy(float)
        r = estimator.weighted(x, y, w)
        return pd.DataFrame({"claim": [key[0]], "rep": [key[1]], "r": [np.nan if r is None else r]})

    got = weights.groupBy("claim", "rep").applyInPandas(of, "claim int, rep int, r double")
    return got.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def intervals(reps: DataFrame, info: DataFrame, replicates: int = REPLICATES, level: float = LEVEL) -> DataFrame:
    """claim, ci_lo, ci_hi, n_units, mode: order statistics, null under three units or half the replicates."""
    a = (1 - level) / 2
    found = reps.groupBy("claim").agg(F.sort_array(F.collect_list("r")).alias("r"))  # at most ``replicates`` values
    found = info.join(found, "claim", "left").withColumn("n", F.coalesce(F.size("r"), F.lit(0)))
    enough = (F.col("g") >= 3) & (F.col("n") >= max(replicates // 2, 1))
    lo, hi = F.floor(F.lit(a) * F.col("n")), F.least(F.floor(F.lit(1 - a) * F.col("n")), F.col("n") - 1)
    pick = lambda i: F.when(enough, F.get("r", i.cast("int")))
    return found.select("claim", pick(lo).alias("ci_lo"), pick(hi).alias("ci_hi"), F.col("g").alias("n_units"), "mode")
