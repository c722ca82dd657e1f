"""Published results of example projects, where a folder with those projects is named in $ATTEST_EXAMPLES."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

import pytest

from attest.plans.beliefs import load
from attest.plans.check import check
from attest.sources.joblog import JobLog

# Fixed values, as published: estimate, interval, units and verdict of each claim, by the number of rows that a project reads.
CLAIMS = {
    100: [(0.936426, 0.911862, 0.958671, 10, "refuted"), (0.157235, -0.004375, 0.303321, 10, "agrees")],
    1274: [(-0.450, -0.509, -0.388, 493, "agrees"), (-0.589, -0.651, -0.525, 493, "refuted")],
}
DIGITS = {100: 6, 1274: 3}


def projects() -> list[Path]:
    top = os.environ.get("ATTEST_EXAMPLES")
    return sorted(p.parent for p in Path(top).glob("*/context.toml")) if top else []


@pytest.mark.skipif(not projects(), reason="no example projects are named")
@pytest.mark.parametrize("source", projects())
def test_published_results(spark, tmp_path, source):
    root = tmp_path / "project"
    shutil.copytree(source, root, ignore=lambda _, names: [n for n in names if n == "results"], copy_function=shutil.copyfile)
    for d, _, _ in os.walk(root):
        os.chmod(d, 0o755)
    report = check(spark, str(root), mode="mt19937")
    whole = report.as_dict()
    digits = DIGITS[whole["rows_read"]]
    assert [(*(round(r[k], digits) for k in ("estimate", "ci_lo", "ci_hi")), r["n_units"], r["verdict"]) for r in report.rows] == CLAIMS[whole["rows_read"]]
    if whole["rows_read"] != 1274:
        return
    assert [(j["n_left"], j["n_right"], j["n_matched"], j["coverage"]) for j in whole["joins"]] == [(637, 637, 637, 1.0)]
    (root / "results").mkdir()
    (root / "results/claims.json").write_text(json.dumps(whole, default=str))
    graph = load(spark, str(root))
    told = graph.summary().first()
    assert (told.claims, told.nodes, told.caveat_deliveries, told.open_questions) == (6, 6, 2, 2)
    assert {k: len(v) for k, v in graph.report()["caveats"].items()} == {"mace": 2, "affinity": 0}
    jobs = JobLog.of_project(spark, str(root)).summary()
    assert (jobs["jobs"], jobs["adjudicable"], jobs["by_verdict"]) == (3, 2, {"agrees": 1, "refuted": 1, "unadjudicated": 1})
