"""Job logs as PROV-O, and the two axioms by which challenges spread.

Every job is a row, so statements are made on the executors and written as lines; only ``render`` gathers them, for a
project's own log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_timestamp
from ..operators.jobs import with_derived
from ..sources.joblog import JobLog
from .project import Project
from .triples import BASE, PREFIXES, escaped, iri, link, made, say, turtle


def _id(kind: str, name: Column, tail: str = "") -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), escaped(name), F.lit(tail))


def _when(s: Column, p: str, value: Column) -> tuple[Column, Column]:
    """A time as it was written, typed only if it looks like one."""
    return value != "", say(s, p, value, F.when(is_timestamp(value), F.lit(iri("xsd:dateTime"))))


def statements(jobs: DataFrame) -> DataFrame:
    """Expected outputs stay on the plan; only confirmed ones become entities."""
    j = with_derived(jobs)
    job, plan, assoc, agent = _id("job", F.col("id")), _id("job", F.col("id"), "/criterion"), _id("job", F.col("id"), "/association"), _id("agent", F.col("agent"))
    some = lambda c: F.col(c) != ""
    able = F.col("adjudicable")
    one = made(
        j,
        [
            link(job, "rdf:type", "prov:Activity"),
            say(job, "rdfs:label", F.col("id")),
            say(job, "dct:description", F.col("question")),
            _when(job, "prov:startedAtTime", F.col("started")),
            _when(job, "prov:endedAtTime", F.col("ended")),
            (some("note"), say(job, "rdfs:comment", F.col("note"))),
            (some("agent"), link(job, "prov:wasAssociatedWith", agent)),
            (some("agent"), link(agent, "rdf:type", "prov:SoftwareAgent")),
            (some("agent"), say(agent, "rdfs:label", F.col("agent"))),
            (able, link(plan, "rdf:type", "prov:Plan")),
            (able, say(plan, "rdfs:label", F.concat(F.lit("acceptance criterion for "), F.col("id")))),
            (able & some("check"), say(plan, "dct:description", F.col("check"))),
            (able, link(assoc, "rdf:type", "prov:Association")),
            (able, link(assoc, "prov:hadPlan", plan)),
            (able & some("agent"), link(assoc, "prov:agent", agent)),
            (able, link(job, "prov:qualifiedAssociation", assoc)),
            (some("verdict"), say(job, "at:verdict", F.col("verdict"))),
            (some("verdict"), say(job, "at:status", F.col("status"))),
            (some("superseded_by"), link(job, "dct:isReplacedBy", _id("job", F.col("superseded_by")))),
        ],
    )
    wanted = made(j.select(plan.alias("plan"), F.explode("expected").alias("path")), [say(F.col("plan"), "dct:requires", F.col("path"))])
    entity = _id("entity", F.col("path"))
    out = made(
        j.select(job.alias("job"), F.explode("generated").alias("path")),
        [link(entity, "rdf:type", "prov:Entity"), say(entity, "rdfs:label", F.col("path")), link(entity, "prov:wasGeneratedBy", F.col("job")), link(F.col("job"), "prov:generated", entity)],
    )
    return one.union(wanted).union(out).distinct()


def render(p: Project) -> str:
    return turtle([tuple(r) for r in statements(JobLog.of_project(p.spark, p.catalog).jobs).collect()])


def axioms() -> list[tuple]:
    """``supports`` is transitive, and a direct challenge followed by support is an indirect one."""
    kind, thing = iri("rdf:type"), iri("owl:ObjectProperty")
    first, rest = iri("rdf:first"), iri("rdf:rest")
    supports, direct, indirect = (iri(f"evi:{x}") for x in ("supports", "directlyChallenges", "indirectlyChallenges"))
    return [
        (supports, kind, thing, "iri", None),
        (supports, kind, iri("owl:TransitiveProperty"), "iri", None),
        (indirect, kind, thing, "iri", None),
        (indirect, iri("owl:propertyChainAxiom"), "_:c1", "blank", None),
        ("_:c1", first, direct, "iri", None),
        ("_:c1", rest, "_:c2", "blank", None),
        ("_:c2", first, supports, "iri", None),
        ("_:c2", rest, PREFIXES["rdf"] + "nil", "iri", None),
        ("https://w3id.org/EVI", iri("rdfs:comment"), "Two axioms of EVI 1.6, said again for reasoners that can't fetch it.", "literal", None),
    ]


def render_axioms(p: Project | None = None) -> str:
    return turtle(axioms())
