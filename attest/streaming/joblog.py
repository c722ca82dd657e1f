"""A folder of job logs as a stream: every record of every new file is checked, and a bad line stops the query.

A whole file is read when it appears, so writers move finished files into the folder.  Repeated ids over all files are
found by a state of one row for each id; without an upper bound on lateness that state grows with the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as rules
from ..sources.joblog import parsed


def records(spark: SparkSession, folder: str, agent: str = "") -> DataFrame:
    """Checked records; ``line`` is 0, as a stream has no line numbers."""
    lines = spark.readStream.text(folder).withColumn("line", F.lit(0).cast("long"))
    found = parsed(lines, agent)
    rule = F.when(F.col("_bad").isNotNull(), "not json").otherwise(rules.refusal())
    said = F.concat(F.lit("job "), F.col("id"), F.lit(": "), rule)
    # The check is part of a column that every sink reads, so it can't be pruned.
    checked = F.when(rule.isNotNull(), F.raise_error(said).cast("string")).otherwise(F.col("id"))
    return found.withColumn("id", checked).drop("_bad")


def by_verdict(jobs: DataFrame) -> DataFrame:
    """Running counts by verdict, for a complete or update sink."""
    return rules.by_verdict(jobs)
