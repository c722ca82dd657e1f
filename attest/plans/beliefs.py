"""From declarations to a belief graph: own claims, claims that a verdict settles, claims that a sibling project owns."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog, read
from ..errors import BeliefError, CatalogError
from ..operators.belief import CLAIMS, NODES, RESTS_ON, BeliefGraph, display, judged_claims
from ..session import small_table

VERDICTS = "id string, x string, y string, status string, why string"
RESULTS = "results/claims.json"


def verdict_rows(spark: SparkSession, report: dict[str, Any]) -> DataFrame:
    """A published report's verdicts, as ``judged_claims`` takes them."""
    return small_table(spark, [(r.get("id"), r["x"], r["y"], r["status"], r.get("why", "")) for r in report["relationships"]], VERDICTS)


def tables(spark: SparkSession, declared: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, claims and rests_on of a [belief] table; a root given as text is a list of one."""
    claims = []
    for i, c in enumerate(declared.get("claims", [])):
        if lacks := [k for k in ("subject", "predicate", "object") if not str(c.get(k, "")).strip()]:
            raise BeliefError(f"claim {i} lacks {', '.join(lacks)}")
        owner = str(c.get("defined_in") or "").strip() or None
        if owner and (own := [k for k in ("status", "evidence", "tested_by") if k in c]):
            raise BeliefError(f"claim {i} is defined in {owner!r} and brings its own {', '.join(own)}; only one can decide")
        if not owner and not c.get("tested_by") and not c.get("status"):
            raise BeliefError(f"claim {i} has no status and names nothing that tests it")
        claims.append((i, c["subject"], c["predicate"], c["object"], c.get("status"), c.get("evidence"), c.get("tested_by") or None, owner, str(c.get("note") or "")))
    rests = declared.get("rests_on", {})
    roots = [(k, n) for k, v in rests.items() for n in ([v] if isinstance(v, str) else v)]
    nodes = [(n.get("id"), n.get("kind"), n.get("label", "")) for n in declared.get("nodes", [])]
    return small_table(spark, nodes, NODES), small_table(spark, claims, CLAIMS), small_table(spark, roots, RESTS_ON)


def _imported(spark: SparkSession, claims: DataFrame, siblings: Path) -> DataFrame:
    """claims with those that siblings own filled in from there, one hop and no more."""
    wanted = claims.filter("defined_in is not null").collect()  # declarations
    if not wanted:
        return claims
    owned: dict[int, tuple[str, str | None, str | None]] = {}
    for owner in sorted({c.defined_in for c in wanted}):
        try:
            catalog = read(siblings / owner)
        except CatalogError as e:
            raise BeliefError(f"a claim is defined in {owner!r}: {e}") from e
        if any(c.get("defined_in") for c in catalog.raw.get("belief", {}).get("claims", [])):
            raise BeliefError(f"{owner!r} imports claims itself, so it can't lend any")
        there = load(spark, catalog).claims.withColumn("_name", display()).collect()
        for c in (c for c in wanted if c.defined_in == owner):
            name = f"{c.subject} --{c.predicate}--> {c.object}"
            hits = {(t.status, t.evidence, t.tested_by) for t in there if t._name == name}
            if not hits:
                raise BeliefError(f"{owner!r} makes no claim {name}")
            if len({h[:2] for h in hits}) > 1:
                raise BeliefError(f"{owner!r} makes the claim {name} with several statuses")
            owned[c.idx] = sorted(hits, key=str)[0]
    rows = [(*c[:4], *owned[c.idx], c.defined_in, c.note) if c.idx in owned else tuple(c) for c in claims.collect()]
    return small_table(spark, rows, CLAIMS)


def load(spark: SparkSession, catalog: Catalog | str, verdicts: dict[str, Any] | None = None) -> BeliefGraph:
    """The graph of a project.  verdicts: a report as published; else it is read from the project's results, if any claim
    is tested by one."""
    catalog = read(catalog) if isinstance(catalog, str) else catalog
    declared = catalog.raw.get("belief")
    if not declared:
        raise BeliefError(f"{catalog.name} declares no [belief]")
    nodes, claims, rests_on = tables(spark, declared)
    if any(c.get("tested_by") and not c.get("defined_in") for c in declared.get("claims", [])):
        if verdicts is None:
            path = Path(catalog.root) / RESULTS
            if not path.is_file():
                raise BeliefError(f"claims are tested by verdicts, and {path} is not there; check the claims first")
            verdicts = json.loads(path.read_text())
        claims = judged_claims(claims, verdict_rows(spark, verdicts))
    claims = _imported(spark, claims, Path(catalog.root).resolve().parent)
    return BeliefGraph(nodes, claims, rests_on)
