"""Digests and grades: documents are the files, labels are the runs on record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_digest, store_key, store_name
from ..operators import provenance
from . import register, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document but every ninth is on disk."""
    return table(spark, sf_dir, "documents").filter("doc_id % 9 <> 0").select(F.expr("concat('results/', doc_id, '.txt')").alias("path"), F.sha2(F.col("text"), 256).alias("sha256"), F.expr("cast(doc_id % 50 as double)").alias("modified"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document was made by a rule from itself and from the next one."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        F.expr("concat('results/', doc_id, '.txt')").alias("key"),
        F.expr("concat('rule', quality)").alias("rule"),
        F.expr("map(concat('results/', doc_id, '.txt'), concat('sha256:', case when doc_id % 4 = 0 then 'moved' else sha2(text, 256) end))").alias("input_checksums"),
        F.expr("cast(doc_id % 50 - doc_id % 3 as double)").alias("endtime"),
        F.lit(0.0).alias("starttime"),
        F.lit("cat").alias("code"),
        F.lit(None).cast("string").alias("shellcmd"),
        F.lit(None).cast("string").alias("conda_env"),
        F.lit(None).cast("string").alias("software_stack_hash"),
        F.expr("doc_id % 31 = 0").alias("incomplete"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 29 = 0").select(F.expr("concat('results/', doc_id, '.txt')").alias("key"))


def reproduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.expr("concat('results/', doc_id, '.txt')").alias("path"))


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "documents").select(F.expr("concat('results/', doc_id, '.txt')").alias("path"))
    return provenance.grades(targets, files(spark, sf_dir), records(spark, sf_dir), markers(spark, sf_dir), reproduced(spark, sf_dir))


_G = """d as (select distinct on (doc_id) doc_id, 'results/' || doc_id || '.txt' as path, text from documents),
r as (select d.*, 'rule' || quality as rule, doc_id % 3 > 1 as late, doc_id % 4 = 0 or doc_id % 9 = 0 as moved, doc_id % 31 = 0 as incomplete from d join labels using (doc_id)),
g as (select d.path, r.rule, r.moved, r.late, case when r.path is null and d.doc_id % 29 <> 0 then 'NONE' when d.doc_id % 29 = 0 or r.incomplete then 'DECLARED' when d.doc_id % 9 = 0 then 'DECLARED'
  when d.doc_id % 2 = 1 then 'EXECUTED' when r.moved then 'REPRODUCED' else 'VERIFIED' end as grade from d left join r using (doc_id)),
graded as (select path, grade, rule, case grade when 'DECLARED' then true when 'EXECUTED' then moved or late when 'REPRODUCED' then true else false end as stale from g),
final as (select *, grade in ('EXECUTED', 'REPRODUCED', 'VERIFIED') and not stale as quotable from graded)"""


@register(f"with {_G} select path, grade, rule, stale, quotable from final")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir).select("path", "grade", "rule", "stale", "quotable")


@register(f"with {_G} select grade, count(*) as n, count(*) filter (where quotable) as n_quotable from final group by grade")
def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.counts(_grades(spark, sf_dir))


@register(f"with {_G} select path as key, path as input from r where moved")
def moved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.moved_inputs(records(spark, sf_dir), files(spark, sf_dir))


@register(f"with {_G} select path, rule, 'cat' as recipe, 'snakemake ' || path as regenerate from r where doc_id % 9 = 0")
def vanished_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.vanished(records(spark, sf_dir), files(spark, sf_dir)).select("path", "rule", "recipe", "regenerate")


@register(f"with {_G} select path, doc_id % 9 <> 0 and doc_id % 4 <> 0 as same from d where doc_id % 2 = 0")
def reproduced_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.expr("concat('results/', doc_id, '.txt')").alias("path"), F.expr("case when doc_id % 4 = 0 then 'other' else sha2(text, 256) end").alias("sha256"))
    return provenance.reproduced(before, files(spark, sf_dir))


@register("select doc_id, sha256(coalesce(text, '')) as sha256 from documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@register("select doc_id, replace(replace(to_base64(encode('results/' || doc_id || '/' || source)), '+', '-'), '/', '_') as name, 'results/' || doc_id || '/' || source as key from documents")
def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = store_name(F.expr("concat('results/', doc_id, '/', source)"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), store_key(name).alias("key"))


@register("select doc_id, sha256(source) as digest from documents")
def digest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("concat(case when doc_id % 2 = 0 then 'sha256:' else '' end, sha2(source, 256))")
    return table(spark, sf_dir, "documents").select("doc_id", bare_digest(said).alias("digest"))


@register("select doc_id, case when doc_id % 50 - doc_id % 7 / 2.0 > 1.0 then round(doc_id % 50 - doc_id % 7 / 2.0, 3)::double end as drift from documents")
def file_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = provenance.drift(F.expr("cast(doc_id % 50 as double)"), F.expr("doc_id % 7 / 2.0D"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(late, 3).alias("drift"))
