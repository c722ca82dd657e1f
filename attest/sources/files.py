"""Folders and digests as DataFrames."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Machinery, never data.
SKIPPED = (".snakemake", ".git", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tests")
SCHEMA = "path string, bytes long, modified double, sha256 string"


def local(path: str) -> str:
    """A file: URL as a plain path; anything else as it is."""
    u = urlparse(path)
    return unquote(u.path) if u.scheme == "file" else path


def plain(path: Column) -> Column:
    """Spark's file: URLs as plain paths."""
    return F.url_decode(F.replace(F.regexp_replace(path, r"^file:(//)?(?=/)", ""), F.lit("+"), F.lit("%2B")))


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            with open(path, "rb") as f:
                rows.append((path, os.fstat(f.fileno()).st_size, os.fstat(f.fileno()).st_mtime, hashlib.file_digest(f, "sha256").hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "bytes", "modified", "sha256"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            with open(path, "rb") as f:
                yield pd.DataFrame({"path": [path], "content": [f.read()]})


def _paths(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path) of local files, dealt over the cores; folders are listed with all below them, empty and hidden files too."""
    found: set[str] = set()
    for p in [paths] if isinstance(paths, str) else paths:
        top = Path(local(p))
        found.update(str(f) for f in ([top] if top.is_file() else top.rglob("*")) if f.is_file())
    rows = spark.createDataFrame([(f,) for f in sorted(found)], "path string")
    return rows.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism)))


def digests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, bytes, modified (epoch seconds) and sha256 of each file; folders are read with all below them.

    Files on a path that all executors see are hashed there piece by piece, whatever their size.  Those in another
    store go through Spark's reader, which takes files of up to 2 GB and leaves out empty and hidden ones.
    """
    if all(map(is_local, [paths] if isinstance(paths, str) else paths)):
        return _paths(spark, paths).mapInPandas(_hashed, SCHEMA)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    modified = F.unix_millis("modificationTime") / 1000.0
    return read.select(plain(F.col("path")).alias("path"), F.col("length").alias("bytes"), modified.alias("modified"), F.sha2("content", 256).alias("sha256"))


def contents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and content (binary) of files that are small, as metadata is."""
    if all(map(is_local, [paths] if isinstance(paths, str) else paths)):
        return _paths(spark, paths).mapInPandas(_read, "path string, content binary")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return read.select(plain(F.col("path")).alias("path"), "content")


def digest_of(spark: SparkSession, path: str) -> str | None:
    """One file's digest (or one for a folder's files, by their names); null where there is nothing."""
    if is_local(path) and not os.path.exists(local(path)):
        return None
    rows = digests(spark, path).select("path", "sha256").orderBy("path").collect()
    if len(rows) == 1:
        return rows[0].sha256
    return hashlib.sha256("".join(f"{os.path.basename(r.path)}:{r.sha256}\n" for r in rows).encode()).hexdigest() if rows else None


def under(spark: SparkSession, root: str) -> DataFrame:
    """``digests`` of all files in a folder with their paths relative to it, machinery left out."""
    top = os.path.abspath(local(root)) if is_local(root) else root.rstrip("/")
    found = digests(spark, top).withColumn("path", F.expr(f"substring(path, {len(top) + 2})"))
    machinery = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))
    return found.filter(~machinery)


def with_suffix(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    name = F.lower("path")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.endswith(name, F.lit(s))
    return files.filter(keep)


def targets(spark: SparkSession, root: str, declared: list[str], results: str = "results") -> DataFrame:
    """What a project's statements rest on: all files in its results folder and each declared file, in order of path, with nulls
    where a declared file is missing."""
    named = spark.createDataFrame([(p,) for p in sorted(set(declared))], "path string")
    there = under(spark, root)
    return named.union(there.filter(F.startswith("path", F.lit(results.rstrip("/") + "/"))).select("path")).distinct().join(there, "path", "left").orderBy("path")
