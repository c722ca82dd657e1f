"""Job logs: one JSON object a line, and not one bad line."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, read
from ..errors import JobError
from ..operators import jobs as rules
from ..session import listed

TEXTS = ("id", "question", "check", "verdict", "started", "ended", "agent", "superseded_by", "note")
LISTS = ("expected", "generated")
RECORD = "id string, question string, expected array<string>, check string, verdict string, generated array<string>, started string, ended string, agent string, superseded_by string, note string, _bad string"
ORDER = ("line", "id", "question", "expected", "check", "verdict", "generated", "started", "ended", "agent", "superseded_by", "note")


def numbered(lines: DataFrame) -> DataFrame:
    """lines(value) with ``line``, from 1 in reading order; one count for each partition goes to the driver."""
    at = lines.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = {r._part: r.n for r in at.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, total = [], 0
    for p in sorted(sizes):
        first += [F.lit(p), F.lit(total)]
        total += sizes[p]
    start = F.element_at(F.create_map(*first), F.col("_part")) if first else F.lit(0)
    return at.withColumn("line", start + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part")


def parsed(lines: DataFrame, agent: str = "") -> DataFrame:
    """Records of (line, value), blank lines left out, with ``_bad`` where a line is no JSON object."""
    used = lines.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    record = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = used.select("line", "value", record.alias("r")).select("line", "value", "r.*")
    tidy = {c: F.trim(F.coalesce(c, F.lit(""))) for c in TEXTS} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS}
    tidy["agent"] = F.when(tidy["agent"] == "", F.lit(agent)).otherwise(tidy["agent"])
    # A line that holds something else than an object parses to nulls only.
    shape = F.substring(F.ltrim("value"), 1, 1) != "{"
    return rows.withColumns(tidy).withColumn("_bad", F.when(F.col("_bad").isNotNull() | shape, F.col("value"))).select(*ORDER, "_bad")


def checked(records: DataFrame, source: str = "the job log") -> DataFrame:
    """The records without ``_bad``; the first bad line, refused record or repeated id stops the run."""
    wrong = records.withColumn("_rule", F.when(F.col("_bad").isNotNull(), "not_json").otherwise(rules.refusal())).filter("_rule is not null")
    if first := wrong.orderBy("line").select("line", "id", "_rule").first():
        raise JobError(f"{source}, line {first.line}, job {first.id!r}: {first['_rule'].replace('_', ' ')}")
    good = records.drop("_bad")
    if again := rules.repeated_ids(good).first():
        raise JobError(f"{source}: job {again.id!r} stands on line {again.first_line} and on line {again.line}")
    return good


@dataclass
class JobLog:
    jobs: DataFrame
    agent: str = ""
    source: str = ""

    @classmethod
    def read(cls, spark: SparkSession, path: str, agent: str = "") -> JobLog:
        return cls.of_lines(spark.read.text(path), agent, path)

    @classmethod
    def of_lines(cls, lines: DataFrame, agent: str = "", source: str = "the job log") -> JobLog:
        return cls(checked(parsed(numbered(lines), agent), source), agent, source)

    @classmethod
    def of_project(cls, spark: SparkSession, catalog: Catalog | str) -> JobLog:
        catalog = read(catalog) if isinstance(catalog, str) else catalog
        declared = catalog.raw.get("jobs")
        if not declared:
            raise JobError(f"{catalog.name} declares no [jobs]; no log and an empty one are not the same")
        if not declared.get("records"):
            raise JobError("[jobs] names no records")
        path = catalog.path(declared["records"])
        if "://" not in path and not os.path.isfile(path):
            raise JobError(f"[jobs] names {declared['records']!r}, and there is no such file")
        log = cls.read(spark, path, str(declared.get("agent", "")))
        return cls(log.jobs, log.agent, declared["records"])

    @cached_property
    def derived(self) -> DataFrame:
        return rules.with_derived(self.jobs)

    def undeclared(self) -> DataFrame:
        return rules.undeclared(self.jobs)

    def summary(self) -> dict:
        counts = {r.verdict: r.n for r in rules.by_verdict(self.jobs).orderBy("verdict").collect()}
        return rules.summary(self.jobs).first().asDict() | {"by_verdict": counts}

    def report(self, folder: str | None = None) -> dict:
        """What is published: the summary and every job; those of a long log go to ``folder``."""
        return {"summary": self.summary(), "source": self.source, "jobs": listed(self.derived.orderBy("line").drop("line"), folder, "jobs")}
