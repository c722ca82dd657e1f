"""Job records made of events: every event is a run, its type says how it went."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as rules
from ..sinks import prov
from ..sinks.triples import BASE, PREFIXES, ntriples
from ..sources.joblog import numbered, parsed
from . import register, table

_PATH = "concat('out/', cast(event_id % 5 as string))"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some records break a rule, by their type and number."""
    e = table(spark, sf_dir, "events")
    text = lambda s: F.expr(s).cast("string")
    return e.select(
        F.col("event_id").alias("line"),
        text("concat('job', event_id)").alias("id"),
        text("case when event_id % 17 = 0 then '' else concat('what of user ', user_id) end").alias("question"),
        F.expr("case when event_type in ('purchase', 'error') then array('out/a', concat('out/', event_id % 5)) when event_type = 'view' then array('out/v') else cast(array() as array<string>) end").alias("expected"),
        text("case when event_type = 'signup' then 'it is there' else '' end").alias("check"),
        text("case when event_type = 'purchase' then 'agrees' when event_type = 'error' then 'refuted' when event_type = 'click' and event_id % 3 = 0 then 'agrees' when event_type = 'view' and event_id % 13 = 0 then 'fine' else '' end").alias("verdict"),
        F.expr("case when event_type = 'purchase' then array('out/a', concat('out/', event_id % 4)) when event_type = 'signup' and event_id % 19 = 0 then array('out/s') else cast(array() as array<string>) end").alias("generated"),
        text("date_format(ts, 'yyyy-MM-dd')").alias("started"),
        text("''").alias("ended"),
        text("concat('agent', user_id % 3)").alias("agent"),
        text("case when event_id % 23 = 0 then concat('job', event_id + 1) else '' end").alias("superseded_by"),
        text("''").alias("note"),
    )


_JOBS = """jobs as (select event_id as line, 'job' || event_id as id, case when event_id % 17 = 0 then '' else 'what of user ' || user_id end as question,
  case when event_type in ('purchase', 'error') then ['out/a', 'out/' || (event_id % 5)] when event_type = 'view' then ['out/v'] else []::varchar[] end as expected,
  case when event_type = 'signup' then 'it is there' else '' end as "check",
  case when event_type = 'purchase' then 'agrees' when event_type = 'error' then 'refuted' when event_type = 'click' and event_id % 3 = 0 then 'agrees' when event_type = 'view' and event_id % 13 = 0 then 'fine' else '' end as verdict,
  case when event_type = 'purchase' then ['out/a', 'out/' || (event_id % 4)] when event_type = 'signup' and event_id % 19 = 0 then ['out/s'] else []::varchar[] end as generated,
  strftime(ts, '%Y-%m-%d') as started, 'agent' || (user_id % 3) as agent, case when event_id % 23 = 0 then 'job' || (event_id + 1) else '' end as superseded_by from events),
derived as (select *, len(expected) > 0 or "check" <> '' as adjudicable, list_filter(expected, lambda p: not list_contains(generated, p)) as missing,
  case verdict when 'agrees' then 'measured' when 'refuted' then 'falsified' when 'unverifiable' then 'untested' else '' end as status from jobs),
ruled as (select *, case when trim(id) = '' then 'no_id' when trim(question) = '' then 'no_question' when verdict not in ('', 'agrees', 'refuted', 'unverifiable') then 'unknown_verdict' when verdict <> '' and not adjudicable then 'verdict_without_criterion'
  when verdict = 'agrees' and len(missing) > 0 then 'agrees_with_missing_outputs' when len(generated) > 0 and verdict = '' then 'outputs_without_verdict' end as rule from derived)"""


@register(f"with {_JOBS} select id, rule from ruled where rule is not null")
def job_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).withColumn("rule", rules.refusal()).filter("rule is not null").select("id", "rule")


@register(f"with {_JOBS} select id, adjudicable, status, array_to_string(missing, ',') as missing from derived")
def job_missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_derived(jobs(spark, sf_dir)).select("id", "adjudicable", "status", F.array_join("missing", ",").alias("missing"))


@register(f"with {_JOBS} select case when verdict = '' then 'unadjudicated' else verdict end as verdict, count(*) as n from jobs group by 1")
def jobs_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.by_verdict(jobs(spark, sf_dir))


@register(f"with {_JOBS} select count(*) as jobs, count(*) filter (where adjudicable) as adjudicable, count(*) filter (where not adjudicable) as nothing_declared_to_check, count(*) filter (where superseded_by <> '') as superseded, count(*) filter (where question <> '') as questions_recorded from derived")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.summary(jobs(spark, sf_dir))


@register(f"with {_JOBS} select id from derived where not adjudicable")
def jobs_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.undeclared(jobs(spark, sf_dir)).select("id")


@register("select 'u' || user_id as id, first_line, event_id as line from (select *, min(event_id) over (partition by user_id) as first_line from events) where event_id > first_line")
def job_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"))
    return rules.repeated_ids(again)


@register(
    """select cast(event_id as varchar) as id, event_id % 7 = 0 as bad, case when event_id % 7 = 0 then '' else event_type end as question, case when event_id % 7 = 0 then 0 else 2 end as n_expected from events where event_id % 11 <> 0"""
)
def job_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a log has them: some blank, some cut off."""
    record = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("expected")))
    cut = F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "  ").when(F.col("event_id") % 7 == 0, cut).otherwise(record).alias("value"))
    found = parsed(e.select(F.col("event_id").alias("line"), "value"))
    bad = F.col("_bad").isNotNull()
    return found.select(F.when(bad, F.col("line").cast("string")).otherwise(F.col("id")).alias("id"), bad.alias("bad"), F.when(bad, "").otherwise(F.col("question")).alias("question"), F.when(bad, 0).otherwise(F.size("expected")).alias("n_expected"))


@register("select count(*) as n, min(line) as first, max(line) as last, count(distinct line) as n_lines from (select row_number() over () as line from events)")
def job_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered(table(spark, sf_dir, "events").select(F.col("event_type").alias("value")))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.max("line").alias("last"), F.count_distinct("line").alias("n_lines"))


_P = PREFIXES


@register(
    f"""with {_JOBS}, t(p, o) as (
  select '{_P["rdf"]}type', '{_P["prov"]}Activity' from jobs
  union all select '{_P["rdf"]}type', '{_P["prov"]}Plan' from derived where adjudicable
  union all select '{_P["rdf"]}type', '{_P["prov"]}Association' from derived where adjudicable
  union all select distinct '{_P["rdf"]}type', '{_P["prov"]}SoftwareAgent' || left(agent, 0) from (select distinct agent from jobs)
  union all select '{_P["at"]}verdict', verdict from jobs where verdict <> ''
  union all select '{_P["at"]}status', status from derived where verdict <> '')
select p, o, count(*) as n from t group by all"""
)
def job_prov_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about jobs, counted by kind; entities are many files under few names, so they are left to the next."""
    t = prov.statements(jobs(spark, sf_dir))
    wanted = t.filter(F.col("p").isin(f"{_P['rdf']}type", f"{_P['at']}verdict", f"{_P['at']}status") & ~F.endswith("o", F.lit("Entity")))
    counted = wanted.groupBy("p", "o").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("n", F.when(F.endswith("o", F.lit("SoftwareAgent")), F.lit(1).cast("long")).otherwise(F.col("n")))


@register(f"""with {_JOBS} select distinct '<{BASE}job/' || id || '/criterion> <{_P["dct"]}requires> "' || unnest(expected) || '" .' as value from jobs""")
def job_prov_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = prov.statements(jobs(spark, sf_dir))
    return ntriples(t.filter(F.col("p") == f"{_P['dct']}requires"))
