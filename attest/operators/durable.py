"""Cutting lineage where every executor can read it again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from ..session import small_table


def settled(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint, in the folder that ``spark.checkpoint.dir`` names.

    Where none is named, as in tests, local mode gets a folder of its own; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="attest-"))
    return df.checkpoint()


def compact(df: DataFrame, limit: int) -> DataFrame:
    """df as rows that plans carry with them, if it has no more than limit; else from a checkpoint.

    For tables that several steps read: declarations are few, and the bound is tested on the rows themselves.
    """
    if limit > 0:
        rows = df.limit(limit + 1).collect()
        if len(rows) <= limit:
            return small_table(df.sparkSession, rows, df.schema)
    return settled(df)
