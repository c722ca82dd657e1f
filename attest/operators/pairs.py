"""From rows to pairs: both sides finite, or dropped and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .estimators import pearson


@dataclass(frozen=True)
class Wanted:
    """One claim's columns over a source; a null unit makes every row its own unit."""

    claim: int
    x: Column
    y: Column
    unit: Column | None
    row: Column


def long(source: DataFrame, wanted: list[Wanted]) -> DataFrame:
    """claim, x, y, unit and row for each row and claim, from one scan of the source; x, y and unit may be null."""
    each = [
        F.struct(
            F.lit(w.claim).alias("claim"),
            w.x.alias("x"),
            w.y.alias("y"),
            (F.coalesce(w.unit.cast("string"), F.lit("")) if w.unit is not None else F.lit(None).cast("string")).alias("unit"),
            w.row.cast("long").alias("row"),
        )
        for w in wanted
    ]
    return source.select(F.inline(F.array(*each)))


def usable(pairs: DataFrame) -> DataFrame:
    """The pairs that count.  Values are finite or null by then."""
    return pairs.filter("x is not null and y is not null")


def counted(pairs: DataFrame) -> DataFrame:
    """claim, n_rows kept, rows dropped, whether every kept row's unit is blank, means and Pearson's r, in one pass."""
    kept = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(kept, F.col("x")), F.when(kept, F.col("y"))
    return pairs.groupBy("claim").agg(
        F.count_if(kept).alias("n_rows"),
        F.count_if(~kept).alias("dropped"),
        F.coalesce(F.every(F.when(kept, F.trim("unit") == "")), F.lit(False)).alias("all_blank"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        pearson(x, y).alias("pearson"),
    )
