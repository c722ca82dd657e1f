"""Two verdicts on a metadata document, kept apart: does it follow its standard, and can a reader get at its data?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, UNKNOWN, SKIP = "PASS", "FAIL", "UNKNOWN", "SKIP"


def status(validates: Column, reads: Column) -> Column:
    """SKIP before FAIL before UNKNOWN before PASS."""
    both = F.array(validates, reads)
    out = F.lit(PASS)
    for word in (UNKNOWN, FAIL, SKIP):
        out = F.when(F.array_contains(both, word), word).otherwise(out)
    return out


def read_verdict(n_complaints: Column, n_opened: Column) -> Column:
    """A complaint fails; no complaint passes only if something was opened."""
    return F.when(n_complaints > 0, FAIL).when(n_opened == 0, UNKNOWN).otherwise(PASS)


def complaints(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(document, n_opened, complaints) of entities(document, name, target, bytes, sha256), target being null for what
    is elsewhere, and files(path, bytes, sha256)."""
    there = files.select(F.col("path").alias("target"), F.col("bytes").alias("real_bytes"), F.col("sha256").alias("real_sha256"))
    rows = entities.join(there, "target", "left")
    local = F.col("target").isNotNull()
    absent = local & F.col("real_sha256").isNull()
    found = F.filter(
        F.array(
            F.when(absent, F.concat(F.col("name"), F.lit(" is not there"))),
            F.when(~absent & (F.col("bytes") != F.col("real_bytes")), F.concat(F.col("name"), F.lit(" has another size than is said"))),
            F.when(~absent & (F.col("sha256") != F.col("real_sha256")), F.concat(F.col("name"), F.lit(" has another digest than is said"))),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.groupBy("document").agg(F.count_if(local).alias("n_opened"), F.array_sort(F.flatten(F.collect_list(found))).alias("complaints"))


def rollup(findings: DataFrame) -> DataFrame:
    """One row over findings(kind, declared_version, validates, reads): what was seen, skipped and judged."""
    at = findings.withColumn("status", status(F.col("validates"), F.col("reads")))
    return at.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(F.col("status") != SKIP).alias("metadata_documents"),
        F.count_if(F.col("status") == SKIP).alias("skipped_not_metadata"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in (PASS, FAIL, UNKNOWN)],
        F.count_if((F.col("validates") == PASS) & (F.col("reads") == FAIL)).alias("validated_but_unreadable"),
    )


def by_version(findings: DataFrame) -> DataFrame:
    at = findings.filter(status(F.col("validates"), F.col("reads")) != SKIP)
    return at.groupBy(F.concat_ws(" ", "kind", "declared_version").alias("declared")).agg(F.count(F.lit(1)).alias("n"))
