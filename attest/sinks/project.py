"""What the writers of one project share: declarations, verdicts, digests, sizes and column types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, DatasetSpec, read
from ..errors import PublishError
from ..operators.profile import profile
from ..sources.files import digests
from ..sources.tables import table

RESULTS = "results/claims.json"


def slug(name: str) -> str:
    """Letters and digits stay: identifiers with dots are not resolved by readers."""
    return "".join(c if c.isalnum() else "_" for c in name)


@dataclass
class Project:
    spark: SparkSession
    root: str
    catalog: Catalog = field(init=False)

    def __post_init__(self) -> None:
        self.catalog = read(self.root)

    @property
    def about(self) -> dict[str, Any]:
        return self.catalog.project

    @cached_property
    def claims(self) -> dict[str, Any]:
        """The published verdicts, or none."""
        path = Path(self.root) / RESULTS
        return json.loads(path.read_text()) if path.is_file() else {"relationships": [], "joins": []}

    def require_claims(self) -> dict[str, Any]:
        if not (Path(self.root) / RESULTS).is_file():
            raise PublishError(f"{RESULTS} is not there; check the claims first")
        return self.claims

    @cached_property
    def files(self) -> dict[str, Any]:
        """By declared path: bytes and sha256, all read in one job."""
        paths = {f: str(Path(self.catalog.path(f)).resolve()) for d in self.catalog.datasets.values() for f in d.files}
        there = {f: p for f, p in paths.items() if Path(p).is_file()}
        if not there:
            return {}
        found = {r.path: r for r in digests(self.spark, sorted(set(there.values()))).collect()}  # one row a declared file
        return {f: found[p] for f, p in there.items()}

    @cached_property
    def types(self) -> dict[tuple[str, str], str]:
        """(dataset, column) to its type, one pass for each dataset."""
        out = {}
        for d in self.catalog.datasets.values():
            for r in profile(self._rows(d)).collect():  # one row a column
                out[d.id, r.column] = r.type
        return out

    def _rows(self, d: DatasetSpec):
        parts = [table(self.spark, self.catalog.path(f)) for f in d.files]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows.select([F.col("`" + c.replace("`", "``") + "`").cast("string") for c in parts[0].columns])

    def count(self, verdict: str) -> int:
        return sum(r["verdict"] == verdict for r in self.claims["relationships"])
