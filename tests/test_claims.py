"""Claims checked from files: each of the fifteen stops, and agreement with Python's own generator."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from attest.catalog import parse, reference
from attest.errors import CatalogError, SourceError
from attest.operators import bootstrap
from attest.operators.estimators import ESTIMATORS, Estimator, weighted_pearson
from attest.operators.joins import checked_join
from attest.operators.verdicts import decided
from attest.plans.check import check, check_loaded, plan
from attest.sources.files import digest_of
from attest.sources.tables import csv, load


def project(tmp_path, files: dict[str, str], context: str):
    (tmp_path / "data").mkdir(exist_ok=True)
    for name, text in files.items():
        (tmp_path / "data" / name).write_text(text)
    (tmp_path / "context.toml").write_text(context)
    return str(tmp_path)


def normal_rows(n: int = 200, rho: float = 0.8, groups: int = 20, seed: int = 1) -> list[tuple[float, float, int]]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, e = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((round(x, 6), round(rho * x + (1 - rho * rho) ** 0.5 * e, 6), i % groups))
    return rows


def as_csv(rows, head: str = "x,y,g") -> str:
    return head + "\n" + "\n".join(",".join(str(v) for v in r) for r in rows) + "\n"


HEAD = '[project]\nname = "p"\n[[datasets]]\nid = "d"\norigin = "computed"\nfiles = ["data/d.csv"]\n'
UNITS = '[[variables]]\nname = "x"\nunit = "1"\n[[variables]]\nname = "y"\nunit = "1"\n'


def claim(claimed: float, more: str = "", x: str = "x", y: str = "y", method: str = "pearson", kind: str = "correlation") -> str:
    return f'[[relationships]]\nx = "{x}"\ny = "{y}"\nkind = "{kind}"\nmethod = "{method}"\nclaimed = {claimed}\n{more}\n'


def codes(spark, tmp_path, rows: str, claims: str, units: str = UNITS, **how):
    root = project(tmp_path, {"d.csv": rows}, HEAD + units + claims)
    return check(spark, root, **({"replicates": 200, "mode": "mt19937"} | how)).rows


def python_interval(rows, replicates: int, seed: int):
    """The same by plain resampling of rows by unit."""
    groups: dict = {}
    for x, y, g in rows:
        groups.setdefault(g, []).append((x, y))
    rng, among, stats = random.Random(seed), range(len(groups)), []
    parts = list(groups.values())
    for _ in range(replicates):
        drawn = [p for _ in among for p in parts[rng.choice(among)]]
        n = len(drawn)
        mx, my = sum(a for a, _ in drawn) / n, sum(b for _, b in drawn) / n
        sxx, syy = sum((a - mx) ** 2 for a, _ in drawn), sum((b - my) ** 2 for _, b in drawn)
        if n >= 3 and sxx and syy:
            stats.append(sum((a - mx) * (b - my) for a, b in drawn) / (sxx * syy) ** 0.5)
    stats.sort()
    return stats[int(0.025 * len(stats))], stats[min(int(0.975 * len(stats)), len(stats) - 1)]


def test_agrees_refutes_and_matches_plain_resampling(spark, tmp_path):
    rows = normal_rows()
    found = codes(spark, tmp_path, as_csv(rows), claim(0.8, 'resampling_unit = "g"') + claim(0.0, 'resampling_unit = "g"') + claim(0.8))
    assert [r["verdict"] for r in found] == ["agrees", "refuted", "agrees"]
    assert found[0]["status"] == "measured" and found[1]["status"] == "falsified"
    lo, hi = python_interval(rows, 200, bootstrap.SEED)
    assert found[0]["ci_lo"] == pytest.approx(lo, abs=1e-6) and found[0]["ci_hi"] == pytest.approx(hi, abs=1e-6)
    assert (found[0]["n_units"], found[2]["n_units"]) == (20, 200)


def test_repeated_rows_do_not_narrow_a_clustered_interval(spark, tmp_path):
    rows = [r for r in normal_rows() for _ in range(3)]
    flat, by_unit = codes(spark, tmp_path, as_csv(rows), claim(0.8) + claim(0.8, 'resampling_unit = "g"'), mode="hash")
    assert by_unit["ci_width"] > flat["ci_width"]


@pytest.mark.parametrize("mode", ["hash", "poisson"])
def test_other_draws_give_like_intervals(spark, tmp_path, mode):
    (r,) = codes(spark, tmp_path, as_csv(normal_rows(600, groups=60)), claim(0.8, 'resampling_unit = "g"'), mode=mode, replicates=400)
    assert r["mode"] == mode and 0.7 < r["ci_lo"] < 0.8 < r["ci_hi"] < 0.87


def test_spearman_takes_ranks_anew_in_each_replicate(spark, tmp_path):
    rows = [(x, round(x**3, 6), g) for x, _, g in normal_rows(60)]
    (r,) = codes(spark, tmp_path, as_csv(rows), claim(1.0, 'resampling_unit = "g"', method="spearman"))
    assert (r["estimate"], r["ci_lo"], r["ci_hi"], r["verdict"]) == (1.0, 1.0, 1.0, "agrees")


@pytest.mark.parametrize(
    ("rows", "claims", "units", "code"),
    [
        (as_csv(normal_rows(30)), claim(0.0, method="kendall"), UNITS, "method"),
        (as_csv(normal_rows(30)), claim(0.0, kind="ratio"), UNITS, "kind"),
        (as_csv(normal_rows(30)), claim(0.0, x="e.x"), UNITS, "dataset"),
        (as_csv(normal_rows(30)), claim(0.0, x="z"), UNITS, "columns"),
        (as_csv(normal_rows(30)), claim(0.0), UNITS[: UNITS.rindex("[[")], "units"),
        (as_csv(normal_rows(30)), claim(0.0, 'resampling_unit = "h"'), UNITS, "no_unit_column"),
        (as_csv([(x, y, "") for x, y, _ in normal_rows(12)]), claim(0.0, 'resampling_unit = "g"'), UNITS, "blank_unit"),
        (as_csv([(1, y, g) for _, y, g in normal_rows(12)]), claim(0.0), UNITS, "undefined"),
        (as_csv(normal_rows(2)), claim(0.0), UNITS, "undefined"),
        (as_csv([(x, y, g % 2) for x, y, g in normal_rows(30)]), claim(0.8, 'resampling_unit = "g"'), UNITS, "few_units"),
        (as_csv(normal_rows(8, 0.0)), claim(0.0), UNITS, "wide"),
        (as_csv(normal_rows(8, 0.0)), claim(0.0, "max_ci_width = 2.0"), UNITS, "inside"),
        (as_csv(normal_rows(200)), claim(-0.5), UNITS, "outside"),
    ],
)
def test_each_stop(spark, tmp_path, rows, claims, units, code):
    (r,) = codes(spark, tmp_path, rows, claims, units)
    assert r["reason_code"] == code
    assert r["verdict"] == {"inside": "agrees", "outside": "refuted"}.get(code, "unverifiable")
    assert r["why"]


def test_too_few_replicates_have_a_reason_of_their_own(spark):
    row = [(0, None, None, False, 0.5, None, None, 5, 0.5, None, "g", 9)]
    df = spark.createDataFrame(row, "claim int, stop string, stop_why string, all_blank boolean, estimate double, ci_lo double, ci_hi double, n_units long, claimed double, max_ci_width double, resampling_unit string, n_rows long")
    assert decided(df).first().reason_code == "few_replicates"


@pytest.mark.parametrize(("noise", "verdict"), [(1e-7, "agrees"), (1e-5, "refuted")])
def test_a_claimed_one_is_met_to_rounding_only(spark, tmp_path, noise, verdict):
    r = random.Random(3)
    rows = []
    for i in range(60):
        x = r.gauss(0, 1)
        rows.append((repr(x), repr(x * (1 + noise * r.gauss(0, 1))), i))
    assert codes(spark, tmp_path, as_csv(rows), claim(1.0))[0]["verdict"] == verdict


def test_joins_of_two_datasets(spark, tmp_path):
    head = '[project]\nname = "p"\n' + "".join(f'[[datasets]]\nid = "{d}"\norigin = "computed"\nfiles = ["data/{d}.csv"]\n' for d in "ab")
    units = "".join(f'[[variables]]\ndataset = "{d}"\nname = "v"\nunit = "1"\n' for d in "ab")
    rows = normal_rows(100)
    files = {"a.csv": "k,v,g\n" + "".join(f"{i},{x},{g}\n" for i, (x, _, g) in enumerate(rows)), "b.csv": "k,v,g\n" + "".join(f"{i},{y},{g}\n" for i, (_, y, g) in enumerate(rows[:90]))}
    one = 'x = "a.v"\ny = "b.v"\nkind = "correlation"\nmethod = "pearson"\nclaimed = 0.8\n'
    root = project(tmp_path, files, head + units + f'[[relationships]]\n{one}join = "k"\n[[relationships]]\n{one}[[relationships]]\n{one}join = "g"\n[[relationships]]\n{one}join = "q"\n')
    report = check(spark, root, replicates=100)
    a, b, c, d = report.rows
    # Both columns are called v, and each side's own is read.
    assert a["verdict"] == "agrees" and a["estimate"] < 0.95
    assert a["join"]["coverage"] == 0.9 and a["join"]["n_left_unmatched"] == 10
    assert [r["reason_code"] for r in (b, c, d)] == ["no_join", "join_refused", "join_refused"]
    assert "more than one row of a" in c["why"] and "no column 'q'" in d["why"]
    whole = report.as_dict()
    assert whole["rows_read"] == 190 and whole["any_unverifiable"] and not whole["any_refuted"]


def test_join_refusals_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    joined, report = checked_join(a, b, "k")
    assert [(r.l.v, r.r.v) for r in joined.collect()] == [("x", "p")] and report.n_matched == 1
    twice, report = checked_join(a.union(a), b, "k")
    assert twice is None and report.n_duplicate_keys_left == 2
    empty, report = checked_join(a.limit(0), b, "k")
    assert empty.count() == 0 and report.coverage == 0.0


def test_an_added_estimator_is_used(spark, tmp_path):
    from pyspark.sql import functions as F

    def point(pairs):
        return pairs.groupBy("claim").agg(F.corr("x", "y").alias("estimate"))

    ESTIMATORS["mine"] = Estimator("mine", "correlation", point, weighted_pearson)
    try:
        (r,) = codes(spark, tmp_path, as_csv(normal_rows(40)), claim(0.8, 'resampling_unit = "g"', method="mine"))
    finally:
        del ESTIMATORS["mine"]
    assert r["verdict"] == "agrees"


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿x,y,"a,b"\n1,,"two\nlines"\n2\n3,"say ""hi""",z\n'.encode())
    df = csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y", "a,b"]
    assert [tuple(r) for r in df.collect()] == [("1", "", "two\nlines"), ("2", "", ""), ("3", 'say "hi"', "z")]
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    with pytest.raises(SourceError, match="repeats"):
        csv(spark, str(tmp_path / "b.csv"))


def test_csv_without_line_breaks_in_cells_is_split(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    Path(path).write_text("k,t\n" + "".join(f'{i},"a ""b"" {i}"\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = csv(spark, path)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 5000
        assert df.filter("k = '4999'").first().t == 'a "b" 4999'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sources_are_refused(spark, tmp_path):
    root = project(tmp_path, {"d.csv": "x\n1\n", "e.csv": "x\n", "f.csv": "x\n2\n"}, "")
    digest = digest_of(spark, f"{root}/data/d.csv")

    def one(**spec):
        c = parse({"project": {"name": "p"}, "datasets": [{"id": "d", "origin": "manual", "files": ["data/d.csv"], "source": "s", "retrieved": "now", "sha256": digest} | spec]}, root)
        return load(spark, c, c.datasets["d"])

    assert one().rows.count() == 1
    assert one(files=["data/d.csv", "data/f.csv"], sha256={"data/d.csv": digest, "data/f.csv": digest_of(spark, f"{root}/data/f.csv")}).rows.count() == 2
    for spec, words in [({"origin": "found"}, "origin"), ({"source": None}, "source"), ({"sha256": "0" * 64}, "is declared with"), ({"files": ["data/q.csv"]}, "no file"), ({"origin": "computed", "files": ["data/e.csv"]}, "no rows"), ({"files": []}, "no files")]:
        with pytest.raises(SourceError, match=words):
            one(**spec)


def test_catalog_refuses_what_is_ambiguous():
    assert reference("a.b.c") == ("a", "b.c") and reference("x", "d") == ("d", "x")
    with pytest.raises(CatalogError):
        reference("x")
    base = {"project": {"name": "p"}, "datasets": [{"id": "a"}, {"id": "b"}]}
    for bad in ({}, base | {"datasets": [{"id": "a"}, {"id": "a"}]}, base | {"variables": [{"name": "x"}]}, base | {"relationships": [{"x": "a.b"}]}, base | {"datasets": [{}]}):
        with pytest.raises(CatalogError):
            parse(bad)


def test_plan_reads_no_data():
    c = parse({"project": {"name": "p"}, "datasets": [{"id": "a", "resampling_unit": "u"}], "relationships": [{"x": "a.b", "y": "a.c", "kind": "correlation", "method": "pearson", "claimed": 0}]})
    (p,) = plan(c)
    assert p.unit == "u" and p.stop is None


def test_no_claims_is_an_empty_report(spark, tmp_path):
    root = project(tmp_path, {"d.csv": "x\n1\n"}, HEAD)
    c = parse({"project": {"name": "p"}, "datasets": [{"id": "d", "origin": "computed", "files": ["data/d.csv"]}]}, root)
    assert check_loaded(spark, c, {"d": load(spark, c, c.datasets["d"])}).rows == []
