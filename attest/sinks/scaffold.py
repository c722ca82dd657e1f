"""A project around CSV files: what can be read is filled in, what must be judged is left open.

Nothing is written before every file is accepted, and the written TOML is read back and compared with the data.
"""

from __future__ import annotations

import datetime
import os
import shutil
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..errors import PublishError, SourceError
from ..operators.joins import shared_keys
from ..operators.profile import NUMERIC, profile
from ..sources.files import digest_of
from ..sources.tables import csv


def quoted(text: Any) -> str:
    """A TOML basic string."""
    out = str(text).replace("\\", "\\\\").replace('"', '\\"')
    return '"' + "".join(c if c >= " " and c != "\x7f" else f"\\u{ord(c):04x}" for c in out) + '"'


def slug(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "_" for c in text.lower()).strip("_") or "dataset"


def unique(name: str, taken: set[str]) -> str:
    """The name, or with _2, _3 and so on what is still free."""
    found, n = name, 2
    while found in taken:
        found, n = f"{name}_{n}", n + 1
    taken.add(found)
    return found


def read_profile(spark: SparkSession, path: str) -> dict[str, Any]:
    """Columns with fill counts and types of one CSV file; refuses what would load as something else."""
    name = os.path.basename(path)
    try:
        df = csv(spark, path)
    except SourceError as e:
        raise PublishError(str(e)) from e
    columns = df.columns
    if len(columns) == 1 and any(c in columns[0] for c in "\t;|"):
        raise PublishError(f"{name} has the one column {columns[0][:60]!r}, so it is not separated by commas")
    if blank := [i + 1 for i, c in enumerate(columns) if not c.strip()]:
        raise PublishError(f"{name} has no name for column {', '.join(map(str, blank))}")
    any_filled = " or ".join(f"trim(`{c.replace('`', '``')}`) <> ''" for c in columns)
    rows = profile(df.filter(any_filled)).orderBy("position").collect()
    if not rows or not rows[0].n_rows:
        raise PublishError(f"{name} has a header and no rows")
    return {"frame": df, "columns": columns, "n_rows": rows[0].n_rows, "filled": {r.column: r.n_filled for r in rows}, "types": {r.column: r.type for r in rows}}


def _variable(d: dict[str, Any], column: str) -> list[str]:
    kind, n = d["types"][column], d["filled"][column]
    if n == 0:
        note = "# EMPTY: no row has a value here, so a claim about it stays unverifiable."
    elif kind in NUMERIC:
        note = "# No unit is declared, and none is guessed; until there is one, claims about it stay unverifiable."
    else:
        note = "# Read as text; declare a unit if it is a quantity."
    said = f"{kind}, inferred from {n} of {d['n_rows']} values. Say here what it means."
    return ["[[variables]]", f"dataset = {quoted(d['id'])}", f"name = {quoted(column)}", f"description = {quoted(said)}", note, ""]


def _template(parts: list[dict[str, Any]]) -> list[str]:
    numeric = [f"{d['id']}.{c}" for d in parts for c in d["columns"] if d["types"][c] in NUMERIC]
    x, y = (numeric + ["dataset.column_x", "dataset.column_y"][len(numeric) :])[:2] if len(numeric) < 2 else numeric[:2]
    lines = ["# Claims: none is written, for data says what was measured and never what anyone claimed."]
    if not numeric:
        lines.append("# No column is numeric, so the names below are made up.")
    if dotted := sorted({c for d in parts for c in d["columns"] if "." in c}):
        lines.append(f"# Names are split at their first dot, so these columns can't be referred to: {', '.join(dotted[:4])}")
    lines += ["#", "# [[relationships]]", f"# x = {quoted(x)}", f"# y = {quoted(y)}"]
    if len(parts) > 1:
        keys = shared_keys(*[d["frame"] for d in parts])
        lines.append(f"# join = {quoted(keys[0])}   # it must name a row on both sides" if keys else '# join = "?"   # no column is in all files')
    lines += ['# kind = "correlation"', '# method = "pearson"', "# claimed = 0.0   # the number that somebody claimed", '# resampling_unit = "?"   # the column whose values are independent of each other', "# [relationships.evidence]", '# source = "who claims it, and where"', '# locator = "where exactly"', '# extracted_by = "human"', ""]
    return lines


def context(name: str, parts: list[dict[str, Any]]) -> str:
    today = datetime.date.today().isoformat()
    lines = ["# Counts, types and digests were read from the data; meanings, units and claims are left to you.", "", "[project]", f"name = {quoted(name)}", f"title = {quoted(name)}", ""]
    for d in parts:
        lines += [
            "[[datasets]]",
            f"id = {quoted(d['id'])}",
            'origin = "manual"',
            f"files = [{quoted(d['file'])}]",
            f"title = {quoted(f'{d["source_name"]}: {d["n_rows"]} rows, {len(d["columns"])} columns')}",
            f"source = {quoted(f'Copied from {d["source"]}. Say here where it came from.')}",
            f"retrieved = {quoted(today)}",
            f"sha256 = {quoted(d['sha256'])}",
            "",
        ]
    for d in parts:
        for c in d["columns"]:
            lines += _variable(d, c)
    return "\n".join(lines + _template(parts))


WORKFLOW = """# Checks the claims and describes the data.
import sys

PY = sys.executable
DATA = [{files}]


rule all:
    input:
        "results/claims.json",
        "results/croissant.json",


rule claims:
    input:
        data=DATA,
        context="context.toml",
    output:
        "results/claims.json",
    params:
        py=PY,
    shell:
        "{{params.py}} -m attest check . {{output}}"


rule croissant:
    input:
        data=DATA,
        claims="results/claims.json",
        context="context.toml",
    output:
        "results/croissant.json",
    params:
        py=PY,
    shell:
        "{{params.py}} -m attest emit croissant . {{output}}"
"""

README = """# {name}

{n} data file(s), {rows} rows, {columns} columns, {numeric} of them numeric.

- `context.toml` says what the columns mean and what is claimed about them. Units and claims are yours to fill in.
- `data/` holds the files; their digests are pinned, so a changed file stops the next run.
- `results/` is written by the workflow.
"""


def scaffold(spark: SparkSession, directory: str, data: list[str], name: str | None = None, force: bool = False) -> dict[str, Any]:
    top = Path(directory)
    if not data:
        raise PublishError("a project needs a data file")
    if absent := [d for d in data if not os.path.isfile(d)]:
        raise PublishError(f"no file at {', '.join(absent)}")
    if len({os.path.basename(d) for d in data}) < len(data):
        raise PublishError("two files have one name")
    if top.exists() and any(top.iterdir()) and not force:
        raise PublishError(f"{directory} is not empty")
    taken: set[str] = set()
    parts = []
    for path in data:
        found = read_profile(spark, path)
        base = os.path.basename(path)
        parts.append(found | {"id": unique(slug(Path(path).stem), taken), "source": os.path.abspath(path), "source_name": base, "file": f"data/{base}", "sha256": digest_of(spark, os.path.abspath(path))})
    name = name or slug(top.resolve().name)
    text = context(name, parts)
    try:
        back = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PublishError(f"the context does not parse: {e}") from e
    wrote, want = {(v["dataset"], v["name"]) for v in back.get("variables", [])}, {(d["id"], c) for d in parts for c in d["columns"]}
    if wrote != want:
        raise PublishError(f"the context describes other columns than the data: {sorted(wrote ^ want)}")
    numeric = [f"{d['id']}.{c}" for d in parts for c in d["columns"] if d["types"][c] in NUMERIC]
    total = {"rows": sum(d["n_rows"] for d in parts), "columns": sum(len(d["columns"]) for d in parts)}
    (top / "data").mkdir(parents=True, exist_ok=True)
    for d in parts:
        shutil.copy(d["source"], top / d["file"])
    (top / "context.toml").write_text(text)
    (top / "Snakefile").write_text(WORKFLOW.format(files=", ".join(quoted(d["file"]) for d in parts)))
    (top / "README.md").write_text(README.format(name=name, n=len(parts), numeric=len(numeric), **total))
    datasets = [{"id": d["id"], "file": d["file"], "rows": d["n_rows"], "columns": len(d["columns"]), "sha256": d["sha256"], "types": d["types"]} for d in parts]
    return {"name": name, "directory": directory, "datasets": datasets, **total, "numeric_columns": len(numeric), "undeclared_units": numeric, "relationships": 0}
