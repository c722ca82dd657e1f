"""What text columns hold: fill counts and types, all columns in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import is_blank, is_integer, is_number

INTEGER, FLOAT, TEXT = "sc:Integer", "sc:Float", "sc:Text"
NUMERIC = (INTEGER, FLOAT)


def type_of(n_filled: Column, all_integers: Column, all_numbers: Column) -> Column:
    """Integer, else Float, else Text; a column without values is Text, and so is one with a single non-number."""
    return F.when(n_filled == 0, TEXT).when(all_integers, INTEGER).when(all_numbers, FLOAT).otherwise(TEXT)


def profile(df: DataFrame) -> DataFrame:
    """position, column, n_rows, n_filled and type of each column of df.

    Partial counts meet in one row, whatever the table's size; that row is then turned on its side.
    """
    names = df.columns
    text = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in names]
    counts = []
    for i, c in enumerate(text):
        used = ~is_blank(c)
        counts += [F.count_if(used).alias(f"n{i}"), F.coalesce(F.every(is_integer(c) | ~used), F.lit(True)).alias(f"i{i}"), F.coalesce(F.every(is_number(c) | ~used), F.lit(True)).alias(f"f{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col("n_rows"), F.col(f"n{i}").alias("n_filled"), type_of(F.col(f"n{i}"), F.col(f"i{i}"), F.col(f"f{i}")).alias("type")) for i, c in enumerate(names)])
    return one.select(F.inline(each))


def totals(profiles: DataFrame) -> DataFrame:
    """Rows, columns and numeric columns of profiles(dataset, ...)."""
    each = profiles.groupBy("dataset").agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("type").isin(*NUMERIC)).alias("n_numeric"))
    return each.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_columns").alias("n_columns"), F.sum("n_numeric").alias("n_numeric"))
