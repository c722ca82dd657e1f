"""Profiles of tables read as text, and conformance findings made of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import INTEGER, NUMBER
from ..operators import conform
from ..operators.joins import shared_keys
from ..operators.profile import profile, totals
from . import register, table

_PROFILED = {
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "labels": ("doc_id", "quality", "toxic"),
}


def _profiled(name: str, columns: tuple[str, ...]) -> str:
    # Spark's white space and DuckDB's are the same six ASCII characters here.
    cell = lambda c: f"regexp_replace(coalesce(cast({c} as varchar), ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
    one = f"select '{name}' as dataset, {{i}} as position, '{{c}}' as \"column\", count(*) as n_rows, count(*) filter (where v <> '') as n_filled, case when count(*) filter (where v <> '') = 0 then 'sc:Text' when bool_and(v = '' or regexp_matches(v, '{INTEGER}')) then 'sc:Integer' when bool_and(v = '' or (regexp_matches(v, '{NUMBER}') and isfinite(try_cast(replace(v, '_', '') as double)))) then 'sc:Float' else 'sc:Text' end as type from (select {{v}} as v from {name})"
    return " union all ".join(one.replace("{i}", str(i)).replace("{c}", c).replace("{v}", cell(c)) for i, c in enumerate(columns))


_TYPES = " union all ".join(_profiled(n, c) for n, c in _PROFILED.items())


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, columns in _PROFILED.items():
        rows = table(spark, sf_dir, name).select(*[F.col(c).cast("string") for c in columns])
        one = profile(rows).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register(_TYPES)
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir)


@register(f"with p as ({_TYPES}), d as (select dataset, max(n_rows) as n_rows, count(*) as n_columns, count(*) filter (where type in ('sc:Integer', 'sc:Float')) as n_numeric from p group by dataset) select cast(sum(n_rows) as bigint) as n_rows, cast(sum(n_columns) as bigint) as n_columns, cast(sum(n_numeric) as bigint) as n_numeric from d")
def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_profiles(spark, sf_dir))


@register("select count(*) as n_rows, count(*) filter (where regexp_matches(url, '[^ \\t\\n\\x0B\\f\\r]')) as url, count(*) filter (where regexp_matches(html, '[^ \\t\\n\\x0B\\f\\r]')) as html from pages")
def fill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile(table(spark, sf_dir, "pages").select("url", "html"))
    return found.agg(F.max("n_rows").alias("n_rows"), *[F.max(F.when(F.col("column") == c, F.col("n_filled"))).alias(c) for c in ("url", "html")])


@register("select 'doc_id' as key")
def shared_key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = shared_keys(*[table(spark, sf_dir, t) for t in ("documents", "labels")])
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("PASS", "FAIL", "UNKNOWN", "SKIP")]), (F.col("page_id") % k % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("croissant", "ro-crate", "dcat")]), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.concat(F.lit("1."), F.col("page_id") % 2).alias("declared_version"), word(5).alias("validates"), word(7).alias("reads"))


_FOUND = """f as (select page_id, ['croissant', 'ro-crate', 'dcat'][page_id % 3 + 1] as kind, '1.' || (page_id % 2) as declared_version, ['PASS', 'FAIL', 'UNKNOWN', 'SKIP'][page_id % 5 % 4 + 1] as validates, ['PASS', 'FAIL', 'UNKNOWN', 'SKIP'][page_id % 7 % 4 + 1] as reads from pages),
s as (select *, case when 'SKIP' in (validates, reads) then 'SKIP' when 'FAIL' in (validates, reads) then 'FAIL' when 'UNKNOWN' in (validates, reads) then 'UNKNOWN' else 'PASS' end as status from f)"""


@register(f"with {_FOUND} select page_id, status from s")
def finding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("page_id", conform.status(F.col("validates"), F.col("reads")).alias("status"))


@register(
    f"""with {_FOUND} select count(*) as files_seen, count(*) filter (where status <> 'SKIP') as metadata_documents, count(*) filter (where status = 'SKIP') as skipped_not_metadata, count(*) filter (where status = 'PASS') as n_pass, count(*) filter (where status = 'FAIL') as n_fail,
  count(*) filter (where status = 'UNKNOWN') as n_unknown, count(*) filter (where validates = 'PASS' and reads = 'FAIL') as validated_but_unreadable from s"""
)
def conform_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.rollup(_findings(spark, sf_dir))


@register(f"with {_FOUND} select kind || ' ' || declared_version as declared, count(*) as n from s where status <> 'SKIP' group by 1")
def conform_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.by_version(_findings(spark, sf_dir))


_ENTITIES = """e as (select 'crate' || (page_id % 10) as document, 'p' || page_id as name, case when page_id % 6 = 0 then null else 'p' || page_id end as target, page_id % 4 = 0 as gone, case when page_id % 5 = 0 then 0 else length(coalesce(html, '')) end as bytes, length(coalesce(html, '')) as real from pages)"""


@register(
    f"""with {_ENTITIES}, c as (select *, case when target is null then null when gone then name || ' is not there' when bytes <> real then name || ' has another size than is said' end as said from e)
select document, count(*) filter (where target is not null) as n_opened, count(said) as n_complaints, case when count(said) > 0 then 'FAIL' when count(target) = 0 then 'UNKNOWN' else 'PASS' end as reads from c group by document"""
)
def crate_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    no_digest = F.lit(None).cast("string")
    entities = pages.select(F.concat(F.lit("crate"), (F.col("page_id") % 10).cast("string")).alias("document"), "name", F.when(F.col("page_id") % 6 != 0, F.col("name")).alias("target"), F.when(F.col("page_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("size")).alias("bytes"), no_digest.alias("sha256"))
    files = pages.filter("page_id % 4 <> 0").select(F.col("name").alias("path"), F.col("size").alias("bytes"), F.lit("x").alias("sha256"))
    found = conform.complaints(entities, files)
    n = F.size("complaints")
    return found.select("document", "n_opened", n.cast("long").alias("n_complaints"), conform.read_verdict(n, F.col("n_opened")).alias("reads"))


#: A document for each way that one can be told, and what it is.
_TOLD = (
    ("a.json", '{"@graph": [{"@id": "./"}, {"@id": "ro-crate-metadata.json", "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1/"}}]}', "ro-crate", "1.1"),
    ("b.json", '{"conformsTo": "http://mlcommons.org/croissant/1.0"}', "croissant", "1.0"),
    ("c.jsonld", '{"dct:conformsTo": {"@id": "http://mlcommons.org/croissant/1.1"}, "recordSet": []}', "croissant", "1.1"),
    ("d.json", '{"cr:recordSet": [NUMBER]}', "croissant", "(undeclared)"),
    ("e.json", '[{"x": ["http://mlcommons.org/croissant/y"]}]', "croissant", "(expanded)"),
    ("f.json", '{"@graph": {"@id": "ro-crate-metadata.json"}, "n": NUMBER}', "?", ""),
    ("g.json", '{"recordSet": [NUMBER', "?", "broken"),
    ("h.ttl", "@prefix dcat: <http://www.w3.org/ns/dcat#> . # NUMBER", "dcat", "plain"),
    ("i.TTL", "<http://metadata.psdi.ac.uk/> a <http://www.w3.org/ns/dcat#Dataset> .", "dcat", "psdi"),
    ("j.ttl", "<a> <b> NUMBER .", "?", ""),
    ("k.json", "NUMBER", "?", ""),
)
_N = len(_TOLD)


def _choose(values: list[str]) -> str:
    return "case page_id % {} {} end".format(len(values), " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)))


@register(f"select page_id, {_choose([t[2] for t in _TOLD])} as kind, replace({_choose([t[3] for t in _TOLD])}, 'broken', '') as version, ({_choose([t[3] for t in _TOLD])}) = 'broken' as broken from pages")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents told by their content, on the executors."""
    from ..plans.conform import _READ, _read

    at = (F.col("page_id") % _N).cast("int")
    chosen = lambda i: F.get(F.array(*[F.lit(t[i]) for t in _TOLD]), at)
    made = table(spark, sf_dir, "pages").select(F.concat_ws("/", "page_id", chosen(0)).alias("path"), F.replace(chosen(1), F.lit("NUMBER"), F.col("page_id").cast("string")).cast("binary").alias("content"))
    found = made.mapInPandas(_read, _READ)
    return found.select(F.split("path", "/")[0].cast("long").alias("page_id"), "kind", "version", F.col("error").isNotNull().alias("broken"))


_CARD = '{"@type": "sc:Dataset", "name": "n", "conformsTo": "http://mlcommons.org/croissant/1.1", "distribution": [{"@type": "cr:FileObject", "@id": "f", "contentUrl": "f.csv", "encodingFormat": "text/csv", "sha256": "DIGEST"}], "recordSet": [{"@type": "cr:RecordSet", "@id": "r", "field": [{"@type": "cr:Field", "@id": "r/a", "dataType": "sc:Text", "source": {"fileObject": {"@id": "f"}, "extract": {"column": "a"}}}]}]}'
#: A change to a sound card, and how many faults it makes.
_CHANGES = (("", "", 0), ("sc:Dataset", "sc:Thing", 1), ('"name": "n", ', "", 1), ("DIGEST", "not one", 1), ('{"@id": "f"}', '{"@id": "g"}', 1), ('"@id": "r/a"', '"@id": "f"', 1), ('"dataType": "sc:Text", ', "", 1), ('"contentUrl": "f.csv", "encodingFormat": "text/csv", ', "", 2), ('"@type": "cr:FileObject", ', "", 1))


@register(f"select page_id, {_choose([str(c[2]) for c in _CHANGES])}::bigint as n_faults from pages")
def card_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Croissant cards, each with another fault, against the native rules."""
    from ..plans.conform import _READ, _read

    cards = [_CARD.replace(old, new) if old else _CARD for old, new, _ in _CHANGES]
    digest = F.sha2(F.col("page_id").cast("string"), 256)
    made = F.replace(F.get(F.array(*[F.lit(c) for c in cards]), (F.col("page_id") % len(cards)).cast("int")), F.lit("DIGEST"), digest)
    found = table(spark, sf_dir, "pages").select(F.concat_ws("/", "page_id", F.lit("card.json")).alias("path"), made.cast("binary").alias("content")).mapInPandas(_read, _READ)
    return found.select(F.split("path", "/")[0].cast("long").alias("page_id"), F.size("faults").cast("long").alias("n_faults"))


_ENDS = ("csv", "jsonld", "ttl", "bin")
_MEDIA = ("text/csv", "application/ld+json", "text/turtle", "application/octet-stream")


@register(
    f"""select 'd/' || doc_id || '.' || case doc_id % 4 when 0 then 'csv' when 1 then 'jsonld' when 2 then 'ttl' else 'bin' end as id, 'File' as type, doc_id || '.' || case doc_id % 4 when 0 then 'csv' when 1 then 'jsonld' when 2 then 'ttl' else 'bin' end as name,
  strlen(text) as "contentSize", case doc_id % 4 when 0 then '{_MEDIA[0]}' when 1 then '{_MEDIA[1]}' when 2 then '{_MEDIA[2]}' else '{_MEDIA[3]}' end as "encodingFormat", sha256(text) as sha256 from documents where text is not null"""
)
def crate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crate's entries for files whose contents are texts."""
    from ..functions.text import media_type
    from ..sinks.crate import file_entities

    end = F.get(F.array(*[F.lit(e) for e in _ENDS]), (F.col("doc_id") % 4).cast("int"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), end)
    files = table(spark, sf_dir, "documents").filter("text is not null").select(path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return file_entities(files.withColumn("media_type", media_type(F.col("path")))).withColumnsRenamed({"@id": "id", "@type": "type"})


def _project(spark: SparkSession, sf_dir: str):
    """The profiled tables as a project, whose files are the tables."""
    from ..catalog import Catalog, DatasetSpec, Variable
    from ..sinks.project import Project

    found = Project.__new__(Project)
    specs = {n: DatasetSpec(n, "manual" if n == "labels" else "computed", (f"data/{n}.csv",), source="a person", retrieved="2024-01-01", sha256="0" * 64) for n in _PROFILED}
    variables = {(n, c): Variable(n, c, "1" if c.startswith("n_") or c in ("quality", "toxic") else None, f"{c} of {n}") for n, columns in _PROFILED.items() for c in columns}
    about = {"name": "tables", "title": "Some tables", "context": " About them. ", "license": "https://example.org/license", "version": "1", "keywords": ["a", "b"], "date_published": "2024-05-01", "publisher": "P"}
    found.spark, found.root = spark, "."
    found.catalog = Catalog(".", about, specs, variables, (), {"psdi": {"access_rights": "open", "landing_page": "https://example.org/"}})
    sizes = {n: table(spark, sf_dir, n).count() for n in _PROFILED}
    found.__dict__ |= {
        "claims": {"relationships": [{"verdict": v, "evidence": {}} for v in ("refuted", "agrees", "unverifiable", "refuted")], "joins": []},
        "files": {f"data/{n}.csv": Row(bytes=k, sha256=f"{k:064d}") for n, k in sizes.items()},
        "types": {(r.dataset, r.column): r.type for r in _profiles(spark, sf_dir).collect()},
    }
    return found


@register(f"select dataset || '_csv' as file, dataset, \"column\", type as data_type, case when starts_with(\"column\", 'n_') or \"column\" in ('quality', 'toxic') then '1' end as unit from ({_TYPES})")
def croissant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a card declares of the profiled tables."""
    from ..plans.conform import card_faults
    from ..sinks.croissant import NS, build

    card = build(_project(spark, sf_dir))
    if faults := card_faults(card):
        raise ValueError("; ".join(faults))
    rows = [(f["source"]["fileObject"]["@id"], s[f"{NS}dataset"], f["source"]["extract"]["column"], f["dataType"], f.get(f"{NS}unit")) for s in card["recordSet"] for f in s["field"]]
    return spark.createDataFrame(rows, "file string, dataset string, column string, data_type string, unit string")


_SIZES = " union all ".join(f"select '{n}' as t, count(*) as n from {n}" for n in _PROFILED)


@register(
    f"""with f as ({_SIZES}) select 'dct:title' as term, 'Some tables' as value union all select 'dct:identifier', 'tables' union all select 'dct:description', 'About them.' union all select 'dct:issued', '2024-05-01' union all select 'dct:hasVersion', '1'
  union all select 'dcat:keyword', unnest(['a', 'b']) union all select 'foaf:name', 'P' union all select 'dct:title', t || '.csv' from f union all select 'dcat:downloadURL', 'data/' || t || '.csv' from f union all select 'dcat:mediaType', 'text/csv' from f
  union all select 'dcat:byteSize', n::varchar from f union all select 'spdx:checksumValue', lpad(n::varchar, 64, '0') from f union all select 'dct:provenance', case when t = 'labels' then 'Put here by hand from a person, retrieved 2024-01-01.' else 'Made by the project''s workflow, whose records name its inputs, code and environment.' end from f
  union all select 'at:claimsChecked', '4' union all select 'at:claimsRefuted', '2' union all select 'at:claimsUnverifiable', '1'"""
)
def dcat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalogue record of the profiled tables says in literals."""
    from ..sinks import catalogue

    return _literals(catalogue.dcat(_project(spark, sf_dir)).table(spark))


def _literals(statements: DataFrame) -> DataFrame:
    from ..sinks.triples import PREFIXES

    short = F.col("p")
    for prefix, address in PREFIXES.items():
        short = F.when(F.col("p").startswith(address), F.concat(F.lit(f"{prefix}:"), F.substr(F.col("p"), F.lit(len(address) + 1)))).otherwise(short)
    return statements.filter("kind = 'literal'").select(short.alias("term"), F.col("o").alias("value"))


@register("select 'exempt' as covered, unnest(['DisplayPriorityPropertyShape', 'IdentifierPropertyShape', 'LogoURLPropertyShape']) as shape union all select 'real', 'closed' union all select 'real', 'IdentifierPropertyShape'")
def psdi_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of the profiled tables against the profile: as it is, and with an identifier made up and a term too many."""
    from ..sinks import catalogue
    from ..sinks.triples import here

    record = catalogue.psdi(_project(spark, sf_dir))
    sound = catalogue.shape_findings(record)
    record.say(here("dataset/tables"), "dct:identifier", "https://resources.psdi.ac.uk/data/none", "xsd:string")
    record.say(here("dataset/tables"), "foaf:name", "n", "xsd:string")
    spoilt = catalogue.shape_findings(record)
    rows = [("exempt", x) for x in sound["exempt"]] + [("real", x) for x in sound["real"] + spoilt["real"]]
    return spark.createDataFrame([(k, x.split(":")[0]) for k, x in rows], "covered string, shape string")
