"""The one join: by a key that names a row on both sides, or not at all."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JoinReport:
    key: str
    left: str
    right: str
    n_left: int | None = None
    n_right: int | None = None
    refused: str | None = None
    n_matched: int | None = None
    n_left_unmatched: int | None = None
    n_right_unmatched: int | None = None
    coverage: float | None = None
    n_duplicate_keys_left: int | None = None
    n_duplicate_keys_right: int | None = None

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key value: how often each side has it.  Counts combine before the shuffle, so a hot key moves once
    per task; null keys count as one value."""
    sides = left.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.col(key).cast("string").alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes, matches, misses, coverage and how many key values each side repeats."""
    counts = key_counts(left, right, key)
    one = F.lit(1)
    return counts.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0) & F.col("key").isNotNull()).alias("n_matched"),
        F.count_if(F.col("l") > one).alias("n_duplicate_keys_left"),
        F.count_if(F.col("r") > one).alias("n_duplicate_keys_right"),
        F.min(F.when(F.col("l") > one, F.coalesce("key", F.lit("")))).alias("example_left"),
        F.min(F.when(F.col("r") > one, F.coalesce("key", F.lit("")))).alias("example_right"),
    ).select(
        "n_left",
        "n_right",
        "n_matched",
        (F.col("n_left") - F.col("n_matched")).alias("n_left_unmatched"),
        (F.col("n_right") - F.col("n_matched")).alias("n_right_unmatched"),
        F.round(F.col("n_matched") / F.greatest("n_left", one), 4).alias("coverage"),
        "n_duplicate_keys_left",
        "n_duplicate_keys_right",
        "example_left",
        "example_right",
    )


def checked_join(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> tuple[DataFrame | None, JoinReport]:
    """(joined, report); joined is None where the report says why the join was refused.

    Joined columns are the structs ``l`` and ``r``, so no column of one side hides one of the other.  The left side's
    repeats are reported before the right side's.  A null key matches nothing, and more than one makes a repeat.
    """
    for side, df in zip(names, (left, right)):
        if key not in df.columns:
            return None, JoinReport(key, *names, refused=f"{side} has no column {key!r}")
    found = coverage(left, right, key).first()
    report = {k: found[k] for k in found.asDict() if not k.startswith("example")}
    for side, name in zip(("left", "right"), names):
        if n := found[f"n_duplicate_keys_{side}"]:
            why = f"{n} value{'s' * (n > 1)} of {key!r} stand on more than one row of {name}, such as {found[f'example_{side}']!r}"
            kept = {k: report[k] for k in ("n_left", "n_right", "n_duplicate_keys_left", "n_duplicate_keys_right")}
            return None, JoinReport(key, *names, refused=why, **kept)
    l = left.select(F.col(key).cast("string").alias("_key"), F.struct("*").alias("l"))
    r = right.select(F.col(key).cast("string").alias("_key"), F.struct("*").alias("r"))
    return l.join(r, "_key").drop("_key"), JoinReport(key, *names, **report)


def shared_keys(*frames: DataFrame) -> list[str]:
    """Columns that all frames have, in alphabetical order."""
    return sorted(set.intersection(*[set(f.columns) for f in frames])) if frames else []
