"""May this file be quoted?  Grades for a project, from its store and its folders."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CONTEXT, read
from ..operators import provenance
from ..operators.durable import settled
from ..session import listed
from ..sources import files, store


def _relative(keys: DataFrame, root: str, column: str = "key") -> DataFrame:
    """Records name outputs relative to the project or in full."""
    top = os.path.abspath(root).rstrip("/") + "/"
    return keys.withColumn(column, F.when(F.startswith(column, F.lit(top)), F.substr(column, F.lit(len(top) + 1))).otherwise(F.col(column)))


def grade_project(spark: SparkSession, root: str, paths: list[str] | None = None, reproduced: list[str] = ()) -> DataFrame:
    """The grades of the named files, or of all in results/ and all declared, in order of path."""
    catalog = read(root) if (Path(root) / CONTEXT).is_file() else None
    declared = [f for d in catalog.datasets.values() for f in d.files] if catalog else []
    there = files.under(spark, root)
    records = _relative(store.records(spark, root), root)
    records = records.withColumn("input_checksums", F.transform_keys("input_checksums", lambda k, v: F.regexp_replace(k, "^" + re.escape(os.path.abspath(root).rstrip("/") + "/"), "")))
    if paths is not None:
        targets = spark.createDataFrame([(p,) for p in paths], "path string")
    else:
        targets = files.targets(spark, root, declared, catalog.project.get("results", "results") if catalog else "results").filter("sha256 is not null").select("path")
    again = spark.createDataFrame([(p,) for p in reproduced], "path string")
    return provenance.grades(targets, there, records, _relative(store.unfinished(spark, root), root), again).orderBy("path")


def vanished(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """What is gone, and how many outputs are on record at all: with none, nothing was compared."""
    keys = _relative(store.recorded_outputs(spark, root), root)
    known = keys.join(_relative(store.records(spark, root), root), "key", "left")
    return provenance.vanished(known, files.under(spark, root)), keys.count()


def report(spark: SparkSession, root: str, paths: list[str] | None = None, reproduced: list[str] = (), folder: str | None = None) -> dict:
    """Counts, and the grade of every file; those of very many go to ``folder``."""
    graded = settled(grade_project(spark, root, paths, reproduced))
    total = graded.agg(F.count(F.lit(1)).alias("n"), F.count_if("quotable").alias("quotable")).first()
    rows = listed(graded.orderBy("path"), folder, "grades")
    return {
        "root": root,
        "files": total.n,
        "quotable": total.quotable,
        "by_grade": {r.grade: r.n for r in provenance.counts(graded).orderBy("grade").collect()},
        "grades": {r.pop("path"): {k: v for k, v in r.items() if k != "extra"} | r["extra"] for r in rows} if isinstance(rows, list) else rows,
    }
