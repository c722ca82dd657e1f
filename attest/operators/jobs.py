"""Job records: what a run was for, what would have counted, and what came out.

jobs(line, id, question, expected, check, verdict, generated, started, ended, agent, superseded_by, note); texts are
trimmed and never null, lists never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import VERDICT_STATUS

UNADJUDICATED = "unadjudicated"


def adjudicable() -> Column:
    """Whether any check could have failed."""
    return (F.size("expected") > 0) | (F.col("check") != "")


def status() -> Column:
    """What a verdict makes of a claim; empty without one."""
    known = F.create_map(*[F.lit(v) for kv in VERDICT_STATUS.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.col("verdict")), F.lit(""))


def missing() -> Column:
    """Expected outputs that were not confirmed, in order, repeats included."""
    return F.filter("expected", lambda p: ~F.array_contains(F.col("generated"), p))


def refusal() -> Column:
    """The first rule that a record breaks; null if it breaks none."""
    return (
        F.when(F.trim("id") == "", "no_id")
        .when(F.trim("question") == "", "no_question")
        .when((F.col("verdict") != "") & ~F.col("verdict").isin(*VERDICT_STATUS), "unknown_verdict")
        .when((F.col("verdict") != "") & ~adjudicable(), "verdict_without_criterion")
        .when((F.col("verdict") == "agrees") & (F.size(missing()) > 0), "agrees_with_missing_outputs")
        .when((F.size("generated") > 0) & (F.col("verdict") == ""), "outputs_without_verdict")
    )


def with_derived(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", status()).withColumn("adjudicable", adjudicable()).withColumn("missing", missing())


def repeated_ids(jobs: DataFrame) -> DataFrame:
    """(id, first_line, line) of every record whose id stood before.

    Ids are counted first, with partial counts, so only repeated ones are ordered.
    """
    often = jobs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")).filter("n > 1")
    return jobs.select("id", "line").join(often, "id").filter("line > first_line").select("id", "first_line", "line").orderBy("line")


def by_verdict(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.when(F.col("verdict") == "", UNADJUDICATED).otherwise(F.col("verdict")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def undeclared(jobs: DataFrame) -> DataFrame:
    """The backlog: runs of which nobody said what would count."""
    return jobs.filter(~adjudicable())


def summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(adjudicable()).alias("adjudicable"),
        F.count_if(~adjudicable()).alias("nothing_declared_to_check"),
        F.count_if(F.col("superseded_by") != "").alias("superseded"),
        F.count_if(F.col("question") != "").alias("questions_recorded"),
    )


