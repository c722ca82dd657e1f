"""A workflow's own store of run records, read whole and joined; one record is found by its file's name.

The store keeps one JSON file for each output, named by the output's path in URL-safe base64; a name beyond the file
system's limit is cut into folders marked by @.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import store_key
from .files import contents, is_local, local

STORE = ".snakemake"
RECORD = (
    "rule string, input array<string>, input_checksums map<string,string>, code string, shellcmd string, conda_env string, software_stack_hash string, "
    "starttime double, endtime double, incomplete boolean"
)
RECORDS = f"key string, {RECORD}"


def key_of(path: Column, top: str) -> Column:
    """The output that a store's file stands for; null if it is no record's name."""
    parts = F.split(F.substr(path, F.lit(len(top) + 2)), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    good = F.forall(folders, lambda p: F.startswith(p, F.lit("@")))
    name = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "^@+", "")), "")
    return F.when(good, store_key(name))


def _listed(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """path and content of a store's files, and the folder in full."""
    top = os.path.abspath(local(folder)) if is_local(folder) else folder
    return contents(spark, top), top


def _parsed(files: DataFrame, top: str) -> DataFrame:
    found = files.select(key_of(F.col("path"), top).alias("key"), F.decode("content", "UTF-8").alias("json")).filter("key is not null")
    parsed = found.select("key", F.from_json("json", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "json")
    fine = parsed.filter("r is not null and r._bad is null and ltrim(json) like '{%' and trim(json) <> '{}'")
    return fine.select("key", "r.*").drop("_bad").dropDuplicates(["key"])


def records(spark: SparkSession, root: str, store: str = STORE) -> DataFrame:
    """Every readable record by its key; one that is no JSON object is no record."""
    return _parsed(*_listed(spark, f"{root.rstrip('/')}/{store}/metadata"))


def run_record(spark: SparkSession, root: str, path: str, store: str = STORE) -> dict | None:
    """One output's record, filed under its path in the project or in full; None if there is none.

    Only files whose name is the key's, or a part of it in a folder for long names, are opened.
    """
    full = path if os.path.isabs(path) else os.path.join(os.path.abspath(root), path)
    keys = [os.path.relpath(full, os.path.abspath(root)), full]
    top = f"{root.rstrip('/')}/{store}/metadata"
    if is_local(top):
        there = [f for k in keys for f in _files_of(os.path.abspath(local(top)), k)]
        if not there:
            return None
        found = _parsed(contents(spark, there), os.path.abspath(local(top)))
    else:
        found = records(spark, root, store)
    rows = {r.key: r.asDict() for r in found.filter(F.col("key").isin(keys)).collect()}
    return next((rows[k] for k in keys if k in rows), None)


def _files_of(top: str, key: str) -> list[str]:
    """Where a key's record may be: its name, whole or cut anywhere into folders marked by @."""
    name, found, folders = base64.urlsafe_b64encode(key.encode()).decode(), [], [(top, 0)]
    while folders:
        folder, at = folders.pop()
        rest = name[at:]
        if os.path.isfile(os.path.join(folder, rest)):
            found.append(os.path.join(folder, rest))
        if os.path.isdir(folder):
            folders += [(e.path, at + len(e.name) - 1) for e in os.scandir(folder) if e.is_dir() and e.name.startswith("@") and rest.startswith(e.name[1:]) and len(e.name) > 1]
    return found


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    files, top = _listed(spark, folder)
    return files.select(key_of(F.col("path"), top).alias("key")).filter("key is not null").distinct()


def recorded_outputs(spark: SparkSession, root: str, store: str = STORE) -> DataFrame:
    """(key): every output that the store has a file for, decoded from the names alone."""
    return _keys(spark, f"{root.rstrip('/')}/{store}/metadata").orderBy("key")


def unfinished(spark: SparkSession, root: str, store: str = STORE) -> DataFrame:
    """(key): outputs whose run began and did not end."""
    return _keys(spark, f"{root.rstrip('/')}/{store}/incomplete")
