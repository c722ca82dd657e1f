"""Columns, claims, evidence, verdicts and beliefs as one graph, joined at the column and at the digest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..operators.belief import BeliefGraph, bearers
from ..plans.beliefs import load
from .croissant import NS, build as card_of
from .project import Project, slug
from .triples import Statements, here, turtle

EVI = "https://w3id.org/EVI"


def _columns(p: Project, g: Statements) -> set[str]:
    card = card_of(p)
    project = here(f"project/{p.catalog.name}")
    g.link(project, "rdf:type", "sc:Dataset")
    g.say(project, "sc:name", p.catalog.name)
    for f in card["distribution"]:
        at = here(f"file/{f['name']}")
        g.link(at, "rdf:type", "cr:FileObject")
        g.say(at, "sc:name", f["name"])
        g.say(at, "sc:sha256", f["sha256"])
        g.say(at, "at:origin", f[f"{NS}origin"])
        g.say(at, "at:manualSource", f.get(f"{NS}manualSource"))
        g.say(at, "at:retrieved", f.get(f"{NS}retrieved"))
        g.link(project, "sc:distribution", at)
    known = set()
    for (d, column), v in p.catalog.variables.items():
        name = f"{d}.{column}"
        known.add(name)
        at = here(f"records/{name}")
        g.link(at, "rdf:type", "cr:Field")
        g.say(at, "sc:name", column)
        g.say(at, "at:inDataset", d)
        g.say(at, "rdfs:comment", v.description)
        if v.unit is not None:
            g.say(at, "at:unit", v.unit)
            g.say(at, "at:unitSystem", "UDUNITS-2")
        g.link(at, "at:inFile", here(f"file/{slug(os.path.basename(p.catalog.datasets[d].files[0]))}"))
    return known


def _claims(p: Project, g: Statements, known: set[str]) -> dict[str, str]:
    """Relationship nodes by id and by pair."""
    named: dict[str, str] = {}
    for i, r in enumerate(p.claims["relationships"], 1):
        at = here(f"relationship/{i}")
        named[f"{r['x']} ~ {r['y']}"] = at
        if r.get("id"):
            named[r["id"]] = at
        g.link(at, "rdf:type", "at:Relationship")
        for role in ("x", "y"):
            full = r[role] if "." in r[role] else f"{p.catalog.only()}.{r[role]}"
            if full in known:
                g.link(at, f"at:{role}", here(f"records/{full}"))
        g.say(at, "at:method", r["method"])
        g.say(at, "at:claimed", r["claimed"], "xsd:double")
        g.say(at, "at:estimate", r.get("estimate"), "xsd:double")
        for k in ("verdict", "status"):
            g.say(at, f"at:{k}", r[k])
        g.say(at, "rdfs:comment", r["why"])
        join = r.get("join")
        if join and not join.get("refused"):
            g.say(at, "at:joinKey", join["key"])
            g.say(at, "at:joinCoverage", join["coverage"], "xsd:double")
            g.say(at, "at:joinMatched", join["n_matched"], "xsd:integer")
        evidence = r.get("evidence", {})
        if evidence.get("locator"):
            e = here(f"evidence/{i}")
            g.link(e, "rdf:type", "evi:Evidence")
            g.say(e, "sc:identifier", evidence["locator"])
            g.say(e, "rdfs:label", evidence.get("source", ""))
            g.say(e, "at:extractedBy", evidence.get("extracted_by", "unknown"))
            g.link(at, "at:restsOn", e)
            g.link(e, "evi:directlySupports", at)
        if r["verdict"] == "refuted":
            v = here(f"verdict/{i}")
            g.link(v, "rdf:type", "evi:Method")
            g.say(v, "rdfs:label", f"{r['method']} recomputed from the data")
            g.link(v, "evi:directlyChallenges", at)
    return named


def _beliefs(b: BeliefGraph, g: Statements, named: dict[str, str]) -> None:
    """Declared nodes and claims; peers have no edge, for support is transitive and they are not."""
    at = here("graph")
    g.link(at, "rdf:type", "owl:Ontology")
    g.link(at, "owl:imports", EVI)
    for n in b.nodes.collect():
        node = here(f"node/{n.id}")
        g.link(node, "rdf:type", "at:Node")
        g.say(node, "at:nodeKind", n.kind)
        g.say(node, "rdfs:label", n.label or n.id)
    borne: dict[int, list[str]] = {}
    for r in bearers(b.claims).collect():
        borne.setdefault(r.idx, []).append(r.node)
    for c in b.claims.orderBy("idx").collect():
        claim = here(f"claim/{c.idx + 1}")
        g.link(claim, "rdf:type", "evi:Claim")
        g.link(claim, "at:subject", here(f"node/{c.subject}"))
        g.say(claim, "at:predicate", c.predicate)
        g.link(claim, "at:object", here(f"node/{c.object}"))
        g.say(claim, "at:status", c.status)
        g.say(claim, "rdfs:comment", c.evidence or None)
        g.say(claim, "skos:note", c.note or None)
        for node in borne.get(c.idx, ()):
            g.link(claim, "evi:supports", here(f"node/{node}"))
        if c.tested_by in named:
            g.link(named[c.tested_by], "evi:supports", claim)
    for e in b.supports_edges().collect():
        g.link(here(f"node/{e.supporter}"), "evi:supports", here(f"node/{e.supported}"))
    for r in b.rests_on.collect():
        art = here(f"artefact/{r.artefact}")
        g.link(art, "rdf:type", "at:Artefact")
        g.say(art, "sc:name", r.artefact)
        g.link(here(f"node/{r.node}"), "evi:supports", art)


def statements(p: Project) -> Statements:
    g = Statements()
    p.require_claims()
    named = _claims(p, g, _columns(p, g))
    if p.catalog.raw.get("belief"):
        _beliefs(load(p.spark, p.catalog, p.claims), g, named)
    return g


def build(p: Project) -> DataFrame:
    return statements(p).table(p.spark)


def render(p: Project) -> str:
    return turtle(statements(p).rows())
