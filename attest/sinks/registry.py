"""Formats by name; installed packages may add or replace some by the entry point group below."""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import SparkSession

from ..errors import PublishError
from ..plans.beliefs import load
from . import catalogue, crate, croissant, graph, prov
from .project import Project

GROUP = "attest.emitters"
Renderer = Callable[[Project], str]

BUILT_IN: dict[str, tuple[Renderer, str]] = {
    "croissant": (croissant.render, "Croissant 1.1: how to read the data"),
    "belief": (lambda p: json.dumps(load(p.spark, p.catalog).report(), indent=2) + "\n", "what rests on what, and what a refutation puts in doubt"),
    "jobs": (prov.render, "PROV-O: why runs were launched, and what would have counted"),
    "graph": (graph.render, "columns and claims as RDF, down to the digests"),
    "evi": (prov.render_axioms, "the two axioms by which challenges spread"),
    "dcat": (catalogue.render_dcat, "DCAT: how to find the data"),
    "psdi": (catalogue.render_psdi, "DCAT in the PSDI profile"),
    "rocrate": (lambda p: crate.render(p.spark, p.root), "RO-Crate 1.1: the whole folder, named and hashed"),
}


def _added() -> dict[str, Renderer]:
    return {e.name: e.load() for e in entry_points(group=GROUP)}


def available() -> dict[str, str]:
    """Each format with a line about it."""
    return {k: what for k, (_, what) in BUILT_IN.items()} | {k: "from another package" for k in _added()}


def get(name: str) -> Renderer:
    added = _added()
    if name in added:
        return added[name]
    if name not in BUILT_IN:
        raise PublishError(f"no format is called {name!r}; there are {', '.join(sorted(available()))}")
    return BUILT_IN[name][0]


def emit(spark: SparkSession, name: str, root: str) -> str:
    return get(name)(Project(spark, root))
