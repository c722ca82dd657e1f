"""Declared tables: read, verified and ready for claims, or refused before any claim is looked at."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, DatasetSpec
from ..errors import SourceError
from ..functions.parse import finite, number
from .files import digest_of

ORIGINS = ("computed", "manual")
MANUAL_NEEDS = ("source", "retrieved", "sha256")
#: The row's place in reading order.
ROW = "_row"


@dataclass(frozen=True)
class Dataset:
    spec: DatasetSpec
    rows: DataFrame
    digests: dict[str, str | None]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != ROW]


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text; an empty or absent cell is the empty text.  Repeated and blank column names are refused.

    A file is split among tasks unless a quoted cell holds a line break.  Such a break leaves a line with an odd number of
    quotes, which is looked for in one scan of the file's parts.
    """
    lines = spark.read.text(path)
    if lines.isEmpty():
        raise SourceError(f"{path} is empty")
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    read = spark.read.options(quote='"', escape='"', multiLine=not lines.filter(odd).isEmpty())
    names = [(c or "").removeprefix("\ufeff") for c in read.csv(path).first()]
    if again := sorted({c for c in names if names.count(c) > 1}):
        raise SourceError(f"{path} repeats the column names {', '.join(again)}")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    return read.options(header=True, enforceSchema=True).schema(schema).csv(path).na.fill("")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or Parquet with its own types."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else csv(spark, path)


def numeric(df: DataFrame, name: str) -> Column:
    """The column as finite doubles, by the one grammar if it is text."""
    kind = dict(df.dtypes)[name]
    c = column(name)
    return number(c) if kind == "string" else finite(c.cast("double"))


def load(spark: SparkSession, catalog: Catalog, spec: DatasetSpec) -> Dataset:
    """Files appended by column name, in order; the first file's header decides which columns there are."""
    if spec.origin not in ORIGINS:
        raise SourceError(f"{spec.id}: origin must be one of {', '.join(ORIGINS)}, not {spec.origin!r}")
    if spec.origin == "manual" and (lacks := [k for k in MANUAL_NEEDS if not getattr(spec, k)]):
        raise SourceError(f"{spec.id} is manual and declares no {', '.join(lacks)}")
    if not spec.files:
        raise SourceError(f"{spec.id} names no files")
    paths = {f: catalog.path(f) for f in spec.files}
    if absent := [f for f, p in paths.items() if "://" not in p and not os.path.exists(p)]:
        raise SourceError(f"{spec.id}: no file at {', '.join(absent)}")
    found = {f: digest_of(spark, p) for f, p in paths.items()}
    if spec.origin == "manual":
        for f, digest in found.items():
            want = spec.sha256.get(f) if isinstance(spec.sha256, dict) else spec.sha256
            if want is None or digest != want.removeprefix("sha256:"):
                raise SourceError(f"{spec.id}: {f} is declared with sha256 {want} and has {digest}")
    parts = [table(spark, p) for p in paths.values()]
    names = parts[0].columns
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select([column(c) for c in names])
    rows = rows.na.fill("") if any(t == "string" for _, t in rows.dtypes) else rows
    if rows.isEmpty():
        raise SourceError(f"{spec.id} has no rows")
    return Dataset(spec, rows.withColumn(ROW, F.monotonically_increasing_id()), found)


def load_all(spark: SparkSession, catalog: Catalog) -> dict[str, Dataset]:
    """Every declared dataset, before any claim."""
    return {k: load(spark, catalog, spec) for k, spec in catalog.datasets.items()}
