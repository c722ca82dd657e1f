"""RDF as a table: s, p, o, kind (iri, blank or literal) and datatype.

Statements about a project are few and are built on the driver; statements about jobs are built where the jobs are.
Both are tables, so both are joined, closed over and written alike.  Rows of data never become triples.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import DRIVER_EDGES, closure
from ..session import small_table

SCHEMA = "s string, p string, o string, kind string, datatype string"

BASE = "https://example.org/attest/"
PREFIXES = {
    "at": BASE + "ns#",
    "cr": "http://mlcommons.org/croissant/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dct": "http://purl.org/dc/terms/",
    "dcmitype": "http://purl.org/dc/dcmitype/",
    "evi": "https://w3id.org/EVI#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "prov": "http://www.w3.org/ns/prov#",
    "psdi": "http://metadata.psdi.ac.uk/psdi-dcat-ext#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "sc": "https://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "spdx": "http://spdx.org/rdf/terms#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
_SAFE = re.compile(r"[A-Za-z_][\w-]*(?:\.[\w-]+)*")


def iri(name: str) -> str:
    """A prefixed name in full."""
    prefix, colon, rest = name.partition(":")
    return PREFIXES[prefix] + rest if colon and prefix in PREFIXES else name


def here(path: str) -> str:
    """An identifier of our own; characters that no IRI may hold are escaped."""
    return BASE + re.sub(r"[\x00-\x20<>\"{}|\\^`%]", lambda m: f"%{ord(m[0]):02X}", path)


def escaped(name: Column) -> Column:
    """The same for names on the executors; line ends and other control characters become spaces' escapes."""
    out = F.regexp_replace(F.replace(name, F.lit("%"), F.lit("%25")), r"[\x00-\x20]", "%20")
    for c in '<>"{}|\\^`':
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


class Statements:
    """Statements gathered on the driver, each once, in order."""

    def __init__(self) -> None:
        self._rows: dict[tuple[str, str, str, str, str | None], None] = {}

    def link(self, s: str, p: str, o: str) -> None:
        self._rows[iri(s), iri(p), iri(o), "iri", None] = None

    def say(self, s: str, p: str, value: Any, datatype: str | None = None) -> None:
        """A literal; nothing is said of None."""
        if value is not None:
            self._rows[iri(s), iri(p), str(value), "literal", iri(datatype) if datatype else None] = None

    def rows(self) -> list[tuple]:
        return list(self._rows)

    def table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, self.rows(), SCHEMA)


def link(s: Column, p: str, o: Column | str) -> Column:
    """One statement as a struct, for explode."""
    return F.struct(s.alias("s"), F.lit(iri(p)).alias("p"), (F.lit(iri(o)) if isinstance(o, str) else o).alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"))


def say(s: Column, p: str, value: Column, datatype: Column | str | None = None) -> Column:
    kind = datatype if isinstance(datatype, Column) else F.lit(iri(datatype) if datatype else None).cast("string")
    return F.struct(s.alias("s"), F.lit(iri(p)).alias("p"), value.cast("string").alias("o"), F.lit("literal").alias("kind"), kind.alias("datatype"))


def made(df: DataFrame, statements: list[Column | tuple[Column, Column]]) -> DataFrame:
    """Each row's statements, in one pass; (condition, statement) leaves those out whose condition does not hold."""
    given = [F.when(s[0], s[1]) if isinstance(s, tuple) else s for s in statements]
    return df.select(F.explode(F.filter(F.array(*given), lambda x: x.isNotNull())).alias("t")).select("t.*")


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): one line a statement, ready for ``write.text`` at any size."""
    text = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit("")))
    object_ = F.when(F.col("kind") == "literal", literal).when(F.col("kind") == "blank", F.col("o")).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    subject = F.when(F.startswith("s", F.lit("_:")), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return triples.select(F.concat(subject, F.lit(" <"), "p", F.lit("> "), object_, F.lit(" .")).alias("value"))


def _short(name: str, used: set[str]) -> str:
    if name.startswith("_:"):
        return name
    for prefix, space in PREFIXES.items():
        if name.startswith(space) and _SAFE.fullmatch(name[len(space) :]):
            used.add(prefix)
            return f"{prefix}:{name[len(space) :]}"
    return f"<{name}>"


def _quoted(text: str) -> str:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, safe)
    return f'"{text}"'


def turtle(rows: list[tuple]) -> str:
    """A document by subject, for statements about a project (never for rows of data)."""
    used: set[str] = set()
    about: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o, kind, datatype in rows:
        value = _quoted(o) + (f"^^{_short(datatype, used)}" if datatype else "") if kind == "literal" else _short(o, used)
        about[_short(s, used)]["a" if p == iri("rdf:type") else _short(p, used)].append(value)
    body = []
    for s in sorted(about):
        lines = [f"    {p} {', '.join(sorted(set(about[s][p])))}" for p in sorted(about[s], key=lambda p: (p != "a", p))]
        body.append(f"{s}\n" + " ;\n".join(lines) + " .\n")
    return "".join(f"@prefix {p}: <{PREFIXES[p]}> .\n" for p in sorted(used)) + "\n" + "\n".join(body)


def challenged(triples: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(challenger, target): what a direct challenge reaches by one or more ``supports``."""
    supports = triples.filter(F.col("p") == iri("evi:supports")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    direct = triples.filter(F.col("p") == iri("evi:directlyChallenges")).select(F.col("s").alias("challenger"), F.col("o").alias("src"))
    return direct.join(closure(supports, direct.select("src"), driver_edges), "src").select("challenger", F.col("dst").alias("target")).distinct()


def evidence_paths(triples: DataFrame) -> DataFrame:
    """(locator, field, file, sha256): from evidence by its claim and the claim's columns to the bytes."""

    def of(p: str, s: str, o: str) -> DataFrame:
        return triples.filter(F.col("p") == iri(p)).select(F.col("s").alias(s), F.col("o").alias(o))

    ends = of("at:x", "claim", "field").union(of("at:y", "claim", "field"))
    return (
        of("evi:directlySupports", "evidence", "claim")
        .join(of("sc:identifier", "evidence", "locator"), "evidence")
        .join(ends, "claim")
        .join(of("at:inFile", "field", "file"), "field")
        .join(of("sc:sha256", "file", "sha256"), "file")
        .select("locator", "field", "file", "sha256")
        .distinct()
    )
