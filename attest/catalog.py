"""A project's declarations: one TOML file, read on the driver.  Declarations are configuration, never data."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import CatalogError

CONTEXT = "context.toml"


@dataclass(frozen=True)
class Variable:
    dataset: str
    name: str
    unit: str | None = None
    description: str = ""


@dataclass(frozen=True)
class DatasetSpec:
    id: str
    origin: str | None
    files: tuple[str, ...]
    title: str = ""
    source: str | None = None
    retrieved: str | None = None
    #: One digest for a single file, or a digest for each path.
    sha256: str | dict[str, str] | None = None
    resampling_unit: str | None = None


@dataclass(frozen=True)
class Relationship:
    x: str
    y: str
    kind: str
    method: str
    claimed: float
    id: str | None = None
    join: str | None = None
    resampling_unit: str | None = None
    max_ci_width: float | None = None
    evidence: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    root: str
    project: dict[str, Any]
    datasets: dict[str, DatasetSpec]
    variables: dict[tuple[str, str], Variable]
    relationships: tuple[Relationship, ...]
    #: Tables that other parts read: belief, jobs, psdi.
    raw: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return str(self.project.get("name", ""))

    def only(self) -> str | None:
        """The single dataset's id, which bare column names refer to."""
        return next(iter(self.datasets)) if len(self.datasets) == 1 else None

    def unit(self, dataset: str, column: str) -> str | None:
        v = self.variables.get((dataset, column))
        return v.unit if v else None

    def path(self, relative: str) -> str:
        return relative if "://" in relative or relative.startswith("/") else f"{self.root.rstrip('/')}/{relative}"


def reference(text: str, only: str | None = None) -> tuple[str, str]:
    """``dataset.column``, split at the first dot; a bare column needs a single dataset."""
    dataset, dot, column = text.partition(".")
    if dot:
        return dataset, column
    if only is None:
        raise CatalogError(f"{text!r} names no dataset, and the project has several")
    return only, text


def parse(raw: dict[str, Any], root: str = ".") -> Catalog:
    """Check the declarations against each other; whatever is ambiguous stops here."""
    if "project" not in raw or not raw["project"].get("name"):
        raise CatalogError("the context has no [project] with a name")
    datasets: dict[str, DatasetSpec] = {}
    for block in raw.get("datasets", []):
        if not block.get("id"):
            raise CatalogError("a dataset has no id")
        if block["id"] in datasets:
            raise CatalogError(f"two datasets are called {block['id']!r}")
        known = {k: block[k] for k in ("title", "source", "retrieved", "sha256", "resampling_unit") if block.get(k) is not None}
        datasets[block["id"]] = DatasetSpec(id=block["id"], origin=block.get("origin"), files=tuple(block.get("files", ())), **known)
    variables: dict[tuple[str, str], Variable] = {}
    for block in raw.get("variables", []):
        where = block.get("dataset") or (next(iter(datasets)) if len(datasets) == 1 else None)
        if where not in datasets:
            raise CatalogError(f"variable {block.get('name')!r} belongs to dataset {where!r}, which is not declared")
        variables[where, block["name"]] = Variable(where, block["name"], block.get("unit"), block.get("description", ""))
    relationships = []
    for i, block in enumerate(raw.get("relationships", []), 1):
        if missing := [k for k in ("x", "y", "kind", "method", "claimed") if k not in block]:
            raise CatalogError(f"relationship {i} lacks {', '.join(missing)}")
        known = {k: block[k] for k in ("id", "join", "resampling_unit", "max_ci_width") if block.get(k) is not None}
        evidence = {k: str(v) for k, v in block.get("evidence", {}).items()}
        relationships.append(Relationship(x=block["x"], y=block["y"], kind=block["kind"], method=block["method"], claimed=float(block["claimed"]), evidence=evidence, **known))
    return Catalog(root, raw["project"], datasets, variables, tuple(relationships), raw)


def read(root: str | Path) -> Catalog:
    path = Path(root) / CONTEXT
    if not path.is_file():
        raise CatalogError(f"there is no {CONTEXT} in {root}")
    try:
        return parse(tomllib.loads(path.read_text(encoding="utf-8")), str(root))
    except tomllib.TOMLDecodeError as e:
        raise CatalogError(f"{path} does not parse: {e}") from e
