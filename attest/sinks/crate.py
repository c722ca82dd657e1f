"""RO-Crate 1.1: a folder's files, named, sized and hashed."""

from __future__ import annotations

import json
import os
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CONTEXT, read
from ..errors import PublishError
from ..functions.text import media_type
from ..sources.files import under

NAME = "ro-crate-metadata.json"
CONFORMS = "https://w3id.org/ro/crate/1.1"


def payload(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 and media type of all files but the crate's own."""
    return under(spark, root).filter(F.element_at(F.split("path", "/"), -1) != NAME).withColumn("media_type", media_type(F.col("path"))).orderBy("path")


def file_entities(files: DataFrame) -> DataFrame:
    """The crate's entries for files(path, bytes, sha256, media_type), as columns of its JSON."""
    return files.select(
        F.col("path").alias("@id"), F.lit("File").alias("@type"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("bytes").alias("contentSize"), F.col("media_type").alias("encodingFormat"), "sha256",
    )


def build(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> dict[str, Any]:
    about = read(root).project if (Path(root) / CONTEXT).is_file() else {}
    name = about.get("title") or about.get("name") or os.path.basename(os.path.abspath(root))
    top: dict[str, Any] = {
        "@id": "./",
        "@type": "Dataset",
        "name": name,
        "description": about.get("context", "").strip() or name,
        "datePublished": str(about.get("date_published") or date.today().isoformat()),
    }
    listed = file_entities(payload(spark, root).filter(~F.col("path").isin(list(exclude)))).collect()  # a crate lists its files
    files = [r.asDict() for r in listed]
    top["hasPart"] = [{"@id": f["@id"]} for f in files]
    extra = []
    if license_ := str(about.get("license") or ""):
        top["license"] = {"@id": license_} if license_.startswith("http") else license_
        extra += [{"@id": license_, "@type": "CreativeWork"}] * license_.startswith("http")
    descriptor = {"@id": NAME, "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": CONFORMS}}
    return {"@context": [f"{CONFORMS}/context", {"sha256": "http://spdx.org/rdf/terms#checksumValue"}], "@graph": [descriptor, top, *extra, *files]}


def root_of(crate: dict[str, Any]) -> dict[str, Any]:
    """The root dataset, by its name and never by its place."""
    for entity in crate.get("@graph", []):
        if entity.get("@id") == "./":
            return entity
    raise PublishError("the crate has no root dataset './'")


def render(spark: SparkSession, root: str) -> str:
    return json.dumps(build(spark, root), indent=2) + "\n"


def write(spark: SparkSession, root: str, out: str | None = None) -> str:
    """Write the descriptor into the folder that it describes; anywhere else its names would lead nowhere."""
    target = Path(out) if out else Path(root) / NAME
    if target.name != NAME:
        raise PublishError(f"a crate's descriptor is called {NAME}")
    if target.resolve().parent != Path(root).resolve():
        raise PublishError(f"a crate of {root} belongs into {root}, not into {target.parent}")
    target.write_text(render(spark, root))
    return str(target)
