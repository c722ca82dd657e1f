"""The decision over one claim's numbers, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import VERDICT_STATUS

#: An interval wider than this says nothing.
WIDEST = 1.0
#: How near an estimate must be to a claimed 1 or -1, where an interval is a point.
KNOWN_ANSWER = 1e-12

AGREES, REFUTED, UNVERIFIABLE = "agrees", "refuted", "unverifiable"


def reason() -> Column:
    """The first stop that applies, over the columns stop, all_blank, estimate, ci_lo, ci_hi, n_units, claimed and
    max_ci_width."""
    inside = F.col("claimed").between(F.col("ci_lo"), F.col("ci_hi"))
    exact = (F.abs("claimed") == 1.0) & (F.abs(F.col("claimed") - F.col("estimate")) <= KNOWN_ANSWER)
    width = F.col("ci_hi") - F.col("ci_lo")
    return (
        F.when(F.col("stop").isNotNull(), F.col("stop"))
        .when(F.col("all_blank"), "blank_unit")
        .when(F.col("estimate").isNull(), "undefined")
        .when(F.col("ci_lo").isNull() & (F.coalesce("n_units", F.lit(0)) < 3), "few_units")
        .when(F.col("ci_lo").isNull(), "few_replicates")
        .when(~inside & ~exact, "outside")
        .when(~inside, "known_answer")
        .when(width > F.coalesce("max_ci_width", F.lit(WIDEST)), "wide")
        .otherwise("inside")
    )


def verdict(code: Column) -> Column:
    return F.when(code == "outside", REFUTED).when(code.isin("inside", "known_answer"), AGREES).otherwise(UNVERIFIABLE)


def status(verdict: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in VERDICT_STATUS.items() for v in kv])
    return F.element_at(known, verdict)


def sentence(code: Column) -> Column:
    """Why, in words; claims stopped by the planner bring their own."""
    interval = F.format_string("[%.6f, %.6f]", F.col("ci_lo"), F.col("ci_hi"))
    claimed = F.format_string("%s", F.col("claimed"))
    says = {
        "blank_unit": F.concat(F.lit("the resampling unit "), F.col("resampling_unit"), F.lit(" is blank in every usable row")),
        "undefined": F.concat(F.lit("the estimate is undefined over "), F.col("n_rows").cast("string"), F.lit(" usable rows: too few, or a side is constant")),
        "few_units": F.concat(F.lit("no interval: "), F.coalesce("n_units", F.lit(0)).cast("string"), F.lit(" independent units, and it takes 3")),
        "few_replicates": F.lit("no interval: most replicates are undefined"),
        "outside": F.concat(F.lit("claimed "), claimed, F.lit(" lies outside "), interval),
        "known_answer": F.concat(F.lit("claimed "), claimed, F.lit(" is met exactly")),
        "wide": F.concat(F.lit("claimed "), claimed, F.lit(" lies in "), interval, F.lit(", which is too wide to say anything")),
        "inside": F.concat(F.lit("claimed "), claimed, F.lit(" lies in "), interval),
    }
    out = F.when(F.col("stop").isNotNull(), F.col("stop_why"))
    for k, words in says.items():
        out = out.when(code == k, words)
    return out


def decided(rows: DataFrame) -> DataFrame:
    """rows with reason_code, verdict, why, status, and the numbers rounded for reading (decisions come first)."""
    code = F.col("reason_code")
    return (
        rows.withColumn("reason_code", reason())
        .withColumn("verdict", verdict(code))
        .withColumn("why", sentence(code))
        .withColumn("status", status(F.col("verdict")))
        .withColumn("ci_width", F.round(F.col("ci_hi") - F.col("ci_lo"), 6))
        .withColumns({c: F.round(c, 6) for c in ("estimate", "ci_lo", "ci_hi")})
    )


def tallies(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
