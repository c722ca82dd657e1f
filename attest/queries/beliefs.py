"""Closures and caveats over a graph of suppliers, nations and regions, and over the closed vocabulary.

Suppliers depend on nations, nations approximate regions, a supplier is a cheaper surrogate for the next one, every
fourth region pair shares an approximation, and regions are preconditions of the world.  Statuses go by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary
from ..operators import belief
from . import register, table


def _node(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, letter, key, kind: table(spark, sf_dir, name).select(_node(letter, key).alias("id"), F.lit(kind).alias("kind"), F.lit("").alias("label"))
    world = spark.createDataFrame([("w", "reference", "")], belief.NODES)
    return of("supplier", "s", "s_suppkey", "method").union(of("nation", "n", "n_nationkey", "quantity")).union(of("region", "r", "r_regionkey", "reference")).union(world)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    status = F.when(key % 7 == 0, "falsified").when(key % 7 == 1, "assumed").when(key % 7 == 2, "untested").otherwise("measured")
    evidence = F.when(key % 7 == 2, "").otherwise(F.concat(F.lit("run "), key.cast("string")))

    def says(df: DataFrame, idx, subject, predicate: str, obj, status, evidence) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(idx.cast("int").alias("idx"), subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), status.alias("status"), evidence.alias("evidence"), none.alias("tested_by"), none.alias("defined_in"), F.lit("").alias("note"))

    nothing = F.lit("")
    return (
        says(s, key, _node("s", "s_suppkey"), "depends_on", _node("n", "s_nationkey"), status, evidence)
        .union(says(n, 100_000_000 + F.col("n_nationkey"), _node("n", "n_nationkey"), "approximates", _node("r", "n_regionkey"), F.when(F.col("n_nationkey") % 5 == 0, "contested").otherwise("assumed"), F.lit("census")))
        .union(says(s.filter("s_suppkey % 5 <> 4"), 200_000_000 + key, _node("s", "s_suppkey"), "is_cheaper_surrogate_for", F.concat(F.lit("s"), (key + 1).cast("string")), F.lit("by_construction"), nothing))
        .union(says(r.filter("r_regionkey % 2 = 0"), 300_000_000 + F.col("r_regionkey"), _node("r", "r_regionkey"), "shares_approximation_with", F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 5).cast("string")), F.lit("assumed"), nothing))
        .union(says(r, 400_000_000 + F.col("r_regionkey"), _node("r", "r_regionkey"), "is_precondition_of", F.lit("w"), F.lit("published"), F.lit("atlas")))
        .union(says(n.filter("n_nationkey % 3 = 0"), 500_000_000 + F.col("n_nationkey"), _node("n", "n_nationkey"), "approximates", _node("r", "n_regionkey"), F.lit("falsified"), F.lit("recount")))
    )


def rests_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0")
    return s.select(F.concat(F.lit("table"), (F.col("s_suppkey") % 3).cast("string")).alias("artefact"), _node("s", "s_suppkey").alias("node"))


def _vocabulary() -> str:
    def text(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"

    statuses = ", ".join(f"({text(k)}, {', '.join(text(x) for x in v)})" for k, v in vocabulary.STATUSES.items())
    predicates = ", ".join(f"({text(k)}, {', '.join(text(x) for x in v)})" for k, v in vocabulary.PREDICATES.items())
    return f"statuses(status, evidence_required, open_question, carries_caveat) as (values {statuses}), predicates(predicate, stale, doubt, meaning) as (values {predicates})"


_NODES = """nodes as (select 's' || s_suppkey as id from supplier union all select 'n' || n_nationkey from nation union all select 'r' || r_regionkey from region union all select 'w')"""
_CLAIMS = """claims as (
  select s_suppkey as idx, 's' || s_suppkey as subject, 'depends_on' as predicate, 'n' || s_nationkey as object, case s_suppkey % 7 when 0 then 'falsified' when 1 then 'assumed' when 2 then 'untested' else 'measured' end as status, case when s_suppkey % 7 = 2 then '' else 'run ' || s_suppkey end as evidence from supplier
  union all select 100000000 + n_nationkey, 'n' || n_nationkey, 'approximates', 'r' || n_regionkey, case when n_nationkey % 5 = 0 then 'contested' else 'assumed' end, 'census' from nation
  union all select 200000000 + s_suppkey, 's' || s_suppkey, 'is_cheaper_surrogate_for', 's' || (s_suppkey + 1), 'by_construction', '' from supplier where s_suppkey % 5 <> 4
  union all select 300000000 + r_regionkey, 'r' || r_regionkey, 'shares_approximation_with', 'r' || ((r_regionkey + 1) % 5), 'assumed', '' from region where r_regionkey % 2 = 0
  union all select 400000000 + r_regionkey, 'r' || r_regionkey, 'is_precondition_of', 'w', 'published', 'atlas' from region
  union all select 500000000 + n_nationkey, 'n' || n_nationkey, 'approximates', 'r' || n_regionkey, 'falsified', 'recount' from nation where n_nationkey % 3 = 0)"""
_AT = "att as (select c.*, c.subject || ' --' || c.predicate || '--> ' || c.object as claim, s.*exclude (status), p.*exclude (predicate) from claims c join statuses s using (status) join predicates p using (predicate))"
_BASE = f"with recursive {_vocabulary()}, {_NODES}, {_CLAIMS}, {_AT}"
_STALE = """stale(src, dst) as (select distinct case stale when 'backward' then object else subject end, case stale when 'backward' then subject else object end from att where stale is not null),
goes(changed, goes_stale) as (select * from stale union select g.changed, s.dst from goes g join stale s on g.goes_stale = s.src)"""
_DOUBT = """rests(src, dst) as (select distinct case doubt when 'to_subject' then subject else object end, case doubt when 'to_subject' then object else subject end from att where doubt in ('to_subject', 'to_object')),
peers(src, dst) as (select subject, object from att where doubt = 'both_ways' union select object, subject from att where doubt = 'both_ways'),
down(src, dst) as (select id, id from nodes union select d.src, r.dst from down d join rests r on d.dst = r.src),
reach as (select * from down union select d.src, p.dst from down d join peers p on d.dst = p.src)"""
_GIVEN = """rests_on as (select 'table' || (s_suppkey % 3) as artefact, 's' || s_suppkey as root from supplier where s_suppkey % 10 = 0),
bearers as (select idx, unnest(case doubt when 'to_subject' then [subject] when 'to_object' then [object] else list_distinct([subject, object]) end) as node from att),
given as (select r.artefact, a.idx, a.claim, a.status, list_sort(list(distinct r.root)) as via from rests_on r join reach d on d.src = r.root join bearers b on b.node = d.dst join att a on a.idx = b.idx where a.carries_caveat group by all)"""


@register(f"{_BASE}, {_STALE} select changed, goes_stale from goes where changed <> goes_stale")
def stale_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.BeliefGraph(nodes(spark, sf_dir), claims(spark, sf_dir), rests_on(spark, sf_dir)).stale_table()


@register(f"{_BASE}, {_STALE} select changed, goes_stale from goes where changed <> goes_stale and changed like 'n%'")
def stale_if_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed way, from some nodes only."""
    from ..operators.closure import closure

    seeds = nodes(spark, sf_dir).filter("id like 'n%'").select(F.col("id").alias("src"))
    return closure(belief.stale_edges(claims(spark, sf_dir)), seeds, driver_edges=0).select(F.col("src").alias("changed"), F.col("dst").alias("goes_stale"))


@register(f"{_BASE}, {_DOUBT} select src as node, dst as rests_on from reach where src <> dst")
def doubt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = belief.doubt_reach(claims(spark, sf_dir), nodes(spark, sf_dir).select(F.col("id").alias("src")))
    return found.select(F.col("src").alias("node"), F.col("dst").alias("rests_on"))


@register(f"{_BASE}, {_DOUBT} select dst as supporter, src as supported from rests")
def supports_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.rest_edges(claims(spark, sf_dir)).select(F.col("dst").alias("supporter"), F.col("src").alias("supported"))


@register(f"{_BASE}, {_DOUBT}, {_GIVEN} select cast(idx as int) as idx, node from bearers")
def claim_bearers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.bearers(claims(spark, sf_dir))


@register(f"{_BASE}, {_DOUBT}, {_GIVEN} select artefact, cast(idx as int) as idx, claim, status, array_to_string(via, ',') as via from given")
def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = belief.caveats(claims(spark, sf_dir), rests_on(spark, sf_dir))
    return found.select("artefact", "idx", "claim", "status", F.array_join("via", ",").alias("via"))


@register(f"{_BASE} select cast(idx as int) as idx, claim, status, meaning as predicate_means from att where open_question")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.open_questions(claims(spark, sf_dir)).select("idx", "claim", "status", "predicate_means")


@register(f"{_BASE} select subject, predicate, object, array_to_string(list_sort(list(distinct status)), ',') as statuses from claims group by all having count(distinct status) > 1")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.contradictions(claims(spark, sf_dir)).withColumn("statuses", F.array_join("statuses", ","))


@register(
    f"""{_BASE}, {_STALE}, {_DOUBT}, {_GIVEN} select count(*) as claims, count(*) filter (where open_question) as open_questions, cast(0 as bigint) as recomputed, (select count(distinct claim) from given) as caveats,
  (select count(*) from given) as caveat_deliveries, (select count(*) from nodes) as nodes, (select count(distinct artefact) from rests_on) as artefacts, (select count(*) from goes where changed <> goes_stale) as stale_pairs,
  (select count(*) from (select 1 from claims group by subject, predicate, object having count(distinct status) > 1)) as contradictory_triples, cast(0 as bigint) as caveats_undeliverable from att"""
)
def belief_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.BeliefGraph(nodes(spark, sf_dir), claims(spark, sf_dir), rests_on(spark, sf_dir)).summary()


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims with some broken by key, so that each rule has something to find."""
    k = F.col("idx") % 11
    return (
        claims(spark, sf_dir)
        .filter("idx < 100000000")
        .withColumn("predicate", F.when(k == 0, "resembles").otherwise(F.col("predicate")))
        .withColumn("status", F.when(k == 1, "rumoured").otherwise(F.col("status")))
        .withColumn("evidence", F.when(k == 2, "").when(k == 3, "seen").otherwise(F.col("evidence")))
        .withColumn("object", F.when(k == 4, "nowhere").otherwise(F.col("object")))
    )


@register(
    f"""{_BASE}, b as (select idx, idx % 11 as k, subject, case when idx % 11 = 0 then 'resembles' else predicate end as predicate, case when idx % 11 = 4 then 'nowhere' else object end as object,
  case when idx % 11 = 1 then 'rumoured' else status end as status, case idx % 11 when 2 then '' when 3 then 'seen' else evidence end as evidence from claims where idx < 100000000),
v as (select b.*, s.evidence_required, s.status is null as no_status, p.predicate is null as no_predicate from b left join statuses s using (status) left join predicates p on p.predicate = b.predicate)
select cast(idx as int) as idx, rule from v, lateral (select unnest([case when no_predicate then 'predicate' end, case when no_status then 'status' end, case when evidence_required and trim(evidence) = '' then 'evidence_missing' end,
  case when status = 'untested' and trim(evidence) <> '' then 'evidence_forbidden' end, case when object = 'nowhere' then 'node' end]) as rule) where rule is not null"""
)
def belief_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief.violations(nodes(spark, sf_dir), _broken(spark, sf_dir), rests_on(spark, sf_dir)).select("idx", "rule")


@register(f"{_BASE}, twice as (select idx, subject, predicate, object, status, evidence from claims union all select idx + 600000000, subject, predicate, object, status, evidence from claims where idx % 4 = 0) select cast(before as int) as before, cast(idx as int) as idx from (select idx, lag(idx) over (partition by subject, predicate, object, status, evidence order by idx) as before from twice) where before is not null")
def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = claims(spark, sf_dir)
    return belief.duplicates(at.union(at.filter("idx % 4 = 0").withColumn("idx", F.col("idx") + 600_000_000)))


@register(
    f"""{_BASE}, verdicts as (select 'v' || s_suppkey as id, 'a' || s_suppkey as x, 'b' || (s_suppkey // 2) as y, case s_suppkey % 3 when 0 then 'measured' when 1 then 'falsified' else 'untested' end as status, 'because ' || s_suppkey as why from supplier)
select cast(idx as int) as idx, v.status, case when v.status = 'untested' then '' else why end as evidence from claims c join verdicts v on (case when idx % 2 = 0 then v.id = 'v' || idx else v.x || ' ~ ' || v.y = 'a' || idx || ' ~ b' || (idx // 2) end) where idx < 100000000"""
)
def claims_judged_by_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    verdicts = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("v"), k.cast("string")).alias("id"),
        F.concat(F.lit("a"), k.cast("string")).alias("x"),
        F.concat(F.lit("b"), F.floor(k / 2).cast("string")).alias("y"),
        F.when(k % 3 == 0, "measured").when(k % 3 == 1, "falsified").otherwise("untested").alias("status"),
        F.concat(F.lit("because "), k.cast("string")).alias("why"),
    )
    i = F.col("idx").cast("string")
    name = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("v"), i)).otherwise(F.concat(F.lit("a"), i, F.lit(" ~ b"), F.floor(F.col("idx") / 2).cast("string")))
    none = F.lit(None).cast("string")
    tested = claims(spark, sf_dir).filter("idx < 100000000").withColumns({"tested_by": name, "status": none, "evidence": none})
    return belief.judged_claims(tested, verdicts).select("idx", "status", "evidence")


@register(f"with {_vocabulary()} select * from statuses")
def vocabulary_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.statuses(spark)


@register(f"with {_vocabulary()} select * from predicates")
def vocabulary_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.predicates(spark)


@register("select unnest([" + ", ".join(f"'{k}'" for k in vocabulary.NODE_KINDS) + "]) as kind")
def vocabulary_node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.node_kinds(spark)
