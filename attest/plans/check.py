"""Checking declared claims: plan on the driver, recompute in fused passes, decide in one expression.

Claims over the same rows (one dataset, or one join) share a scan: each row is turned into one pair per claim.  One
pass counts and correlates, one sums by unit, and only units meet replicates.  What the planner can refuse, it refuses
before any job: unknown methods, datasets and columns, missing joins and units.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Relationship, read, reference
from ..operators import bootstrap, pairs
from ..operators.estimators import ESTIMATORS
from ..operators.joins import JoinReport, checked_join
from ..operators.verdicts import REFUTED, UNVERIFIABLE, decided
from ..session import small_table
from ..sources.tables import ROW, Dataset, column, load_all, numeric

PLAN = (
    "claim int, id string, x string, y string, x_dataset string, y_dataset string, cross_dataset boolean, kind string, method string, claimed double, "
    "evidence map<string,string>, x_unit string, y_unit string, resampling_unit string, max_ci_width double, stop string, stop_why string"
)
RESULT = (
    "id", "x", "y", "x_dataset", "y_dataset", "cross_dataset", "kind", "method", "claimed", "evidence", "x_unit", "y_unit", "resampling_unit",
    "n_rows", "dropped", "estimate", "ci_lo", "ci_hi", "ci_level", "n_units", "ci_width", "mode", "verdict", "reason_code", "why", "status",
)


@dataclass(frozen=True)
class Planned:
    """A claim with its names resolved, and why it stops before any job, if it does."""

    claim: int
    what: Relationship
    x: tuple[str, str]
    y: tuple[str, str]
    unit: str | None
    stop: tuple[str, str] | None = None

    @property
    def source(self) -> tuple[str, str, str | None]:
        """Claims of one source share a scan."""
        return self.x[0], self.y[0], self.what.join if self.x[0] != self.y[0] else None


@dataclass
class Report:
    catalog: Catalog
    datasets: dict[str, Dataset]
    joins: list[JoinReport]
    #: One row per claim, in the order of RESULT, with ``claim`` before it and the join's report after it.
    verdicts: DataFrame
    rows: list[dict[str, Any]] = field(default_factory=list)

    def as_dict(self) -> dict[str, Any]:
        """What is published; fields that a claim did not come to are left out."""
        n = {k: d.rows.count() for k, d in self.datasets.items()}
        tallies: dict[str, int] = defaultdict(int)
        for r in self.rows:
            tallies[r["verdict"]] += 1
        return {
            "project": self.catalog.name,
            "datasets": {k: {"origin": d.spec.origin, "rows": n[k], "digests": d.digests} for k, d in self.datasets.items()},
            "joins": [j.as_dict() for j in self.joins],
            "rows_read": sum(n.values()),
            "relationships": self.rows,
            "verdicts": dict(sorted(tallies.items())),
            "any_refuted": REFUTED in tallies,
            "any_unverifiable": UNVERIFIABLE in tallies,
        }


def plan(catalog: Catalog) -> list[Planned]:
    """Resolve names and stop what needs no data: method, kind, datasets, a missing join."""
    out = []
    for i, r in enumerate(catalog.relationships):
        x, y = reference(r.x, catalog.only()), reference(r.y, catalog.only())
        known = catalog.datasets.get(x[0])
        unit = r.resampling_unit or (known.resampling_unit if known else None)
        stop = None
        if r.method not in ESTIMATORS:
            stop = ("method", f"no estimator is called {r.method!r}; there are {', '.join(sorted(ESTIMATORS))}")
        elif ESTIMATORS[r.method].kind != r.kind:
            stop = ("kind", f"{r.method} estimates a {ESTIMATORS[r.method].kind}, and the claim is about a {r.kind}")
        elif absent := [d for d in (x[0], y[0]) if d not in catalog.datasets]:
            stop = ("dataset", f"no dataset is called {absent[0]!r}")
        elif x[0] != y[0] and not r.join:
            stop = ("no_join", f"{x[0]} and {y[0]} are two datasets, and no join key lines up their rows")
        out.append(Planned(i, r, x, y, unit, stop))
    return out


def _second_stop(p: Planned, catalog: Catalog, columns: dict[str, list[str]], matched: int | None) -> tuple[str, str] | None:
    """Columns, units and the resampling unit, in this order."""
    for d, c in (p.x, p.y):
        if c not in columns[d] or matched == 0:
            return ("columns", f"{d}.{c} is no column" if c not in columns[d] else f"no row of {p.x[0]} joins one of {p.y[0]}")
    for d, c in (p.x, p.y):
        if catalog.unit(d, c) is None:
            return ("units", f"{d}.{c} has no declared unit")
    if p.unit and p.unit not in columns[p.x[0]] and p.unit not in columns[p.y[0]]:
        return ("no_unit_column", f"the resampling unit {p.unit!r} is no column")
    return None


def _wanted(p: Planned, source: DataFrame, columns: dict[str, list[str]], frames: dict[str, DataFrame]) -> pairs.Wanted:
    """The claim's expressions over its source; of a join the left side's unit goes before the right's."""
    if p.x[0] == p.y[0]:
        df = frames[p.x[0]]
        return pairs.Wanted(p.claim, numeric(df, p.x[1]), numeric(df, p.y[1]), column(p.unit) if p.unit else None, F.col(ROW))
    flat = {("l", c): f"_l_{i}" for i, c in enumerate(columns[p.x[0]])} | {("r", c): f"_r_{i}" for i, c in enumerate(columns[p.y[0]])}
    side = "l" if p.unit in columns[p.x[0]] else "r"
    return pairs.Wanted(p.claim, numeric(source, flat["l", p.x[1]]), numeric(source, flat["r", p.y[1]]), F.col(flat[side, p.unit]) if p.unit else None, F.col("_row"))


def _flattened(joined: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The structs l and r as columns that can't hide each other."""
    return joined.select(F.col(f"l.{ROW}").alias("_row"), *[F.col("l")[c].alias(f"_l_{i}") for i, c in enumerate(left)], *[F.col("r")[c].alias(f"_r_{i}") for i, c in enumerate(right)])


def check(
    spark: SparkSession, catalog: Catalog | str, mode: str = "auto", replicates: int = bootstrap.REPLICATES, seed: int = bootstrap.SEED, level: float = bootstrap.LEVEL
) -> Report:
    """Load, verify and check everything that a project declares; refusals about data stop the run."""
    catalog = read(catalog) if isinstance(catalog, str) else catalog
    datasets = load_all(spark, catalog)
    return check_loaded(spark, catalog, datasets, mode, replicates, seed, level)


def check_loaded(
    spark: SparkSession, catalog: Catalog, datasets: dict[str, Dataset], mode: str = "auto", replicates: int = bootstrap.REPLICATES, seed: int = bootstrap.SEED, level: float = bootstrap.LEVEL
) -> Report:
    columns = {k: d.columns for k, d in datasets.items()}
    frames = {k: d.rows for k, d in datasets.items()}
    joined: dict[tuple, tuple[DataFrame | None, JoinReport]] = {}
    planned = []
    for p in plan(catalog):
        if p.stop is None:
            matched = None
            if p.x[0] != p.y[0]:
                if p.source not in joined:
                    joined[p.source] = checked_join(frames[p.x[0]], frames[p.y[0]], p.what.join, (p.x[0], p.y[0]))
                report = joined[p.source][1]
                matched = report.n_matched
                if report.refused:
                    p = replace(p, stop=("join_refused", report.refused))
            if p.stop is None:
                p = replace(p, stop=_second_stop(p, catalog, columns, matched))
        planned.append(p)

    groups: dict[tuple, list[Planned]] = defaultdict(list)
    for p in planned:
        if p.stop is None:
            groups[p.source].append(p)
    counts, points, spreads = [], [], []
    for source, claims in groups.items():
        rows = frames[source[0]] if source[2] is None else _flattened(joined[source][0], columns[source[0]], columns[source[1]])
        long = pairs.long(rows, [_wanted(p, rows, columns, frames) for p in claims])
        # One row per claim, which later passes and the verdicts share.
        seen = small_table(spark, pairs.counted(long).collect(), "claim int, n_rows long, dropped long, all_blank boolean, mean_x double, mean_y double, pearson double")
        counts.append(seen)
        kept = pairs.usable(long)
        for method in sorted({p.what.method for p in claims}):
            mine = [p.claim for p in claims if p.what.method == method]
            some = kept.filter(F.col("claim").isin(mine))
            estimator = ESTIMATORS[method]
            points.append(seen.filter(F.col("claim").isin(mine)).select("claim", F.col("pearson").alias("estimate")) if method == "pearson" else estimator.point(some))
            reps, info = bootstrap.replicates_of(some, estimator, mode, replicates, seed, seen.select("claim", "mean_x", "mean_y"))
            spreads.append(bootstrap.intervals(reps, info, replicates, level))

    def together(parts: list[DataFrame], schema: str) -> DataFrame:
        out = small_table(spark, [], schema)
        for part in parts:
            out = out.unionByName(part.select(*out.columns))
        return out

    listed = [
        (
            p.claim, p.what.id, p.what.x, p.what.y, p.x[0], p.y[0], p.x[0] != p.y[0], p.what.kind, p.what.method, p.what.claimed, p.what.evidence,
            catalog.unit(*p.x), catalog.unit(*p.y), p.unit, p.what.max_ci_width, *(p.stop or (None, None)),
        )
        for p in planned
    ]
    table = small_table(spark, listed, PLAN)
    for parts, schema in ((counts, "claim int, n_rows long, dropped long, all_blank boolean"), (points, "claim int, estimate double"), (spreads, "claim int, ci_lo double, ci_hi double, n_units long, mode string")):
        table = table.join(F.broadcast(together(parts, schema)), "claim", "left")
    table = table.withColumn("all_blank", F.coalesce("all_blank", F.lit(False))).withColumn("ci_level", F.when(F.col("ci_lo").isNotNull(), F.lit(level)))
    verdicts = decided(table).select("claim", *RESULT).orderBy("claim")
    found = verdicts.collect()  # one row per declared claim
    report = {p.claim: joined[p.source][1] for p in planned if p.source in joined and p.x[0] != p.y[0]}
    rows = []
    for r in found:
        row = r.asDict(recursive=True)
        claim = row.pop("claim")
        row = {k: v for k, v in row.items() if v is not None}
        if claim in report:
            row["join"] = report[claim].as_dict()
        rows.append(row)
    settled = small_table(spark, [tuple(r) for r in found], verdicts.schema)
    return Report(catalog, datasets, [j for _, j in joined.values()], settled, rows)


def summary(report: Report) -> list[str]:
    """One line per claim for the terminal."""
    lines = []
    for r in report.rows:
        number = f" r = {r['estimate']:+.3f} [{r['ci_lo']:+.3f}, {r['ci_hi']:+.3f}] over {r['n_units']} units" if "ci_lo" in r else ""
        lines.append(f"{r['verdict'].upper():<13} {r['x']} ~ {r['y']}: claimed {r['claimed']:+.2f},{number or ' not measured'}. {r['why']}")
    return lines


def join_rows(report: Report) -> list[dict[str, Any]]:
    return [asdict(j) for j in report.joins]
