"""Grades of files by the runs that are on record: one query over all files.

    files(path, sha256, modified)           what is on disk
    records(key, rule, input_checksums, starttime, endtime, incomplete, ...)   what ran
    markers(key)                            what began and did not end

The ladder: no record and no marker is NONE; an unfinished run, or a record whose file is gone, is DECLARED and stale;
a finished run is EXECUTED, stale if an input moved or the file is younger than the run; a file that a re-run gave
again is VERIFIED, or REPRODUCED and stale if an input moved since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_digest

GRADES = ("NONE", "DECLARED", "EXECUTED", "REPRODUCED", "VERIFIED")
QUOTABLE_FROM = "EXECUTED"
#: Seconds by which a file may be younger than its run.
SLACK = 1.0


def drift(modified: Column, ended: Column) -> Column:
    """Seconds that a file is younger than its run, beyond the slack; else null."""
    return F.when(modified - ended > SLACK, modified - ended)


def moved_inputs(records: DataFrame, files: DataFrame) -> DataFrame:
    """(key, input): recorded inputs whose digest is another now, or whose file is gone."""
    had = records.select("key", F.explode("input_checksums").alias("input", "recorded")).filter("coalesce(recorded, '') <> ''").withColumn("want", bare_digest(F.col("recorded")))
    now = files.select(F.col("path").alias("input"), F.col("sha256").alias("now"))
    return had.join(now, "input", "left").filter(~F.col("now").eqNullSafe(F.col("want"))).select("key", "input")


def vanished(records: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded outputs without a file, with what would make each again."""
    gone = records.join(files.select(F.col("path").alias("key")), "key", "left_anti")
    regenerate = F.when(F.col("rule").isNotNull(), F.concat(F.lit("snakemake "), F.col("key")))
    return gone.select(F.col("key").alias("path"), "rule", "starttime", "endtime", F.nullif(F.substring(F.trim(F.coalesce("code", F.lit(""))), 1, 60), F.lit("")).alias("recipe"), regenerate.alias("regenerate")).orderBy("path")


def grades(targets: DataFrame, files: DataFrame, records: DataFrame, markers: DataFrame, reproduced: DataFrame | None = None) -> DataFrame:
    """path, grade, stale, quotable, rule, sha256, changed_inputs, drift and why of targets(path).

    reproduced(path): files that a re-run in a copy gave again, byte by byte.
    """
    moved = moved_inputs(records, files).groupBy("key").agg(F.array_sort(F.collect_set("input")).alias("changed_inputs"))
    rows = (
        targets.select("path")
        .distinct()
        .join(files.select("path", "sha256", "modified"), "path", "left")
        .join(records.withColumnRenamed("key", "path").withColumn("recorded", F.lit(True)), "path", "left")
        .join(markers.select(F.col("key").alias("path"), F.lit(True).alias("marked")).distinct(), "path", "left")
        .join(moved.withColumnRenamed("key", "path"), "path", "left")
    )
    if reproduced is None:
        rows = rows.withColumn("again", F.lit(False))
    else:
        rows = rows.join(reproduced.select("path", F.lit(True).alias("again")).distinct(), "path", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    begun = yes("marked") | yes("incomplete")
    changed = F.coalesce("changed_inputs", F.array().cast("array<string>"))
    has_moved = F.size(changed) > 0
    late = drift(F.col("modified"), F.col("endtime"))
    grade = (
        F.when(~yes("recorded") & ~yes("marked"), "NONE")
        .when(begun, "DECLARED")
        .when(F.col("sha256").isNull(), "DECLARED")
        .when(~yes("again"), "EXECUTED")
        .when(has_moved, "REPRODUCED")
        .otherwise("VERIFIED")
    )
    stale = F.when(grade == "DECLARED", True).when(grade == "EXECUTED", has_moved | late.isNotNull()).otherwise(grade == "REPRODUCED")
    some = F.concat(F.size(changed).cast("string"), F.lit(" recorded inputs are others now ("), F.array_join(F.slice(changed, 1, 3), ", "), F.when(F.size(changed) > 3, ", ...").otherwise(""), F.lit(")"))
    touched = F.format_string("the file is %.1f s younger than its run", late)
    rule = F.coalesce("rule", F.lit("?"))
    why = (
        F.when(grade == "NONE", "no run on record made it")
        .when(begun, F.concat(F.lit("rule "), rule, F.lit(" began and did not end")))
        .when(grade == "DECLARED", F.concat(F.lit("rule "), rule, F.lit(" made it, and it is gone")))
        .when(grade == "EXECUTED", F.concat_ws("; ", F.concat(F.lit("made by rule "), rule, F.lit(", not made again and compared")), F.when(has_moved, some), F.when(late.isNotNull(), touched)))
        .when(grade == "REPRODUCED", F.concat(F.lit("made again alike by rule "), rule, F.lit(", but "), some))
        .otherwise(F.concat(F.lit("made again alike by rule "), rule, F.lit(" from unchanged inputs")))
    )
    return rows.select(
        "path",
        grade.alias("grade"),
        stale.alias("stale"),
        quotable(grade, stale).alias("quotable"),
        F.col("rule"),
        "sha256",
        changed.alias("changed_inputs"),
        late.alias("drift"),
        why.alias("why"),
        F.map_filter(F.create_map(*[x for c in ("shellcmd", "conda_env", "software_stack_hash", "starttime", "endtime") for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()).alias("extra"),
    )


def quotable(grade: Column, stale: Column) -> Column:
    order = F.array(*[F.lit(g) for g in GRADES])
    return (F.array_position(order, grade) >= GRADES.index(QUOTABLE_FROM) + 1) & ~stale


def counts(graded: DataFrame) -> DataFrame:
    return graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.count_if("quotable").alias("n_quotable"))


def reproduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, same) of two digest tables: whether a re-run gave the same bytes."""
    b, a = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    return b.join(a, "path", "left").select("path", (F.col("was").isNotNull() & F.col("was").eqNullSafe(F.col("now"))).alias("same"))
