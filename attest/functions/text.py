"""Small text expressions that reports and sinks share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_TYPES = {".csv": "text/csv", ".json": "application/json", ".jsonld": "application/ld+json", ".jsonl": "application/jsonl", ".ttl": "text/turtle", ".toml": "application/toml", ".md": "text/markdown", ".txt": "text/plain", ".png": "image/png", ".parquet": "application/vnd.apache.parquet"}
ACCESS_RIGHTS = {
    "open": "http://purl.org/coar/access_right/c_abf2",
    "public": "http://purl.org/coar/access_right/c_abf2",
    "embargoed": "http://purl.org/coar/access_right/c_f1cf",
    "restricted": "http://purl.org/coar/access_right/c_16ec",
    "metadata only": "http://purl.org/coar/access_right/c_14cb",
}


def slug(c: Column, mark: str = "_", lower: bool = False) -> Column:
    """Letters and digits of any script stay; ``lower`` also folds case, joins runs and trims marks."""
    if not lower:
        return F.regexp_replace(c, r"[^\p{L}\p{N}]", mark)
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", mark), f"^{mark}+|{mark}+$", "")


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("application/octet-stream"))


def bare_digest(c: Column) -> Column:
    """``sha256:<hex>`` or ``<hex>`` as hex."""
    return F.element_at(F.split(c, ":", 2), -1)


def store_key(c: Column) -> Column:
    """A store's file name (URL-safe base64) as the path it stands for; null if it is none."""
    standard = F.translate(c, "-_", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")


def store_name(path: Column) -> Column:
    return F.translate(F.base64(F.encode(path, "UTF-8")), "+/", "-_")


def is_timestamp(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-"), F.lit(False))


def as_datetime(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("T")), c).otherwise(F.concat(c, F.lit("T00:00:00")))


def access_right(c: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in ACCESS_RIGHTS.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.raise_error(F.concat(F.lit("no access right is called "), c)).cast("string"))


def orcid(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://orcid.org/"), c))


def sentences(c: Column, first: int) -> Column:
    return F.array_join(F.slice(F.split(c, r"(?<=[.:;])\s+(?=[A-Z(])"), 1, first), " ")
