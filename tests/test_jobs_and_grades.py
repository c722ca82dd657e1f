"""Job logs, run-record stores and grades from files."""

from __future__ import annotations

import base64
import hashlib
import json
import os

import pytest

from attest.errors import AttestError, JobError
from attest.operators import jobs as rules
from attest.operators.provenance import GRADES
from attest.plans import grading
from attest.sources import store
from attest.sources.joblog import JobLog
from attest.sources.store import run_record

GOOD = {"id": "j", "question": "why", "expected": ["a"], "check": "", "verdict": "agrees", "generated": ["a"], "started": "2024-01-01", "ended": "", "agent": ""}


def log(spark, *records, agent=""):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return JobLog.of_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), agent)


def test_a_good_log(spark):
    pending = {"id": "k", "question": "what"}
    failed = GOOD | {"id": "l", "verdict": "refuted", "generated": [], "superseded_by": "m"}
    found = log(spark, GOOD, "", pending, failed, agent="me")
    assert found.summary() == {"jobs": 3, "adjudicable": 2, "nothing_declared_to_check": 1, "superseded": 1, "questions_recorded": 3, "by_verdict": {"agrees": 1, "refuted": 1, "unadjudicated": 1}}
    rows = {r.id: r for r in found.derived.collect()}
    assert rows["l"].missing == ["a"] and rows["l"].status == "falsified" and rows["k"].agent == "me" and rows["l"].line == 4
    assert [r.id for r in found.undeclared().collect()] == ["k"]
    assert [j["id"] for j in found.report()["jobs"]] == ["j", "k", "l"]
    assert log(spark).summary()["jobs"] == 0


@pytest.mark.parametrize(
    ("change", "words"),
    [
        ({"id": " "}, "no id"),
        ({"question": ""}, "no question"),
        ({"verdict": "fine"}, "unknown verdict"),
        ({"expected": [], "generated": []}, "without criterion"),
        ({"generated": ["b"]}, "missing outputs"),
        ({"verdict": ""}, "without verdict"),
    ],
)
def test_records_are_refused(spark, change, words):
    with pytest.raises(JobError, match=words):
        log(spark, GOOD | change)


def test_bad_lines_and_repeats_are_named(spark):
    for bad in ('{"id": "j", "ques', "[1]", "3", '"text"'):
        with pytest.raises(JobError, match="line 2.*not json"):
            log(spark, GOOD, bad)
    with pytest.raises(JobError, match="line 1 and on line 3"):
        log(spark, GOOD, GOOD | {"id": "k"}, GOOD)


def test_a_project_without_a_log_is_refused(spark, tmp_path):
    for text, words in [("", "declares no"), ("[jobs]\n", "declares no"), ('[jobs]\nagent = "a"\n', "names no records"), ('[jobs]\nrecords = "j.jsonl"\n', "no such file")]:
        (tmp_path / "context.toml").write_text('[project]\nname = "p"\n' + text)
        with pytest.raises(JobError, match=words):
            JobLog.of_project(spark, str(tmp_path))


def test_missing_outputs_keep_order_and_repeats(spark):
    df = log(spark, GOOD | {"verdict": "refuted", "expected": ["b", "a", "b"], "generated": ["a"]}).jobs
    assert df.select(rules.missing()).first()[0] == ["b", "b"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def put(root, path: str, text: str, when: float | None = None) -> None:
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)
    if when:
        os.utime(f, (when, when))


def record(root, key: str, folder: str = "metadata", raw: str | None = None, **fields) -> None:
    name = base64.urlsafe_b64encode(key.encode()).decode()
    parts = [name[i : i + 200] for i in range(0, len(name), 200)]
    put(root, f".snakemake/{folder}/" + "/".join(["@" + p for p in parts[:-1]] + parts[-1:]), raw if raw is not None else json.dumps({"rule": "r", "starttime": 1.0, "endtime": 1000.0, "code": "cat"} | fields))


def test_the_ladder(spark, tmp_path):
    put(tmp_path, "in.csv", "in", 500)
    for name in ("none", "done", "moved", "late", "again", "again_moved", "begun", "old", "torn"):
        put(tmp_path, f"results/{name}", name, 1000)
    put(tmp_path, "results/late", "late", 2000)
    put(tmp_path, "results/again", "again", 2000)
    same, other = {"in.csv": f"sha256:{sha('in')}"}, {"in.csv": sha("other"), "gone.csv": sha("x")}
    for name in ("done", "late", "again", "begun", "gone"):
        record(tmp_path, f"results/{name}", input_checksums=same)
    for name in ("moved", "again_moved"):
        record(tmp_path, f"results/{name}", input_checksums=other)
    record(tmp_path, "results/begun", "incomplete", "")
    record(tmp_path, "results/old", incomplete=True)
    record(tmp_path, "results/torn", raw='{"rule": ')
    record(tmp_path, str(tmp_path / "results/absolute"))
    put(tmp_path, "results/absolute", "x", 1000)
    long = "results/" + "x" * 180 + "/" + "y" * 180
    record(tmp_path, long)
    names = [f"results/{n}" for n in ("none", "done", "moved", "late", "again", "again_moved", "begun", "old", "torn", "gone", "absolute")]
    again = ["results/again", "results/again_moved"]
    got = {r.path.split("/")[1]: (r.grade, r.stale, r.quotable) for r in grading.grade_project(spark, str(tmp_path), names, again).collect()}
    assert got == {
        "none": ("NONE", False, False),
        "torn": ("NONE", False, False),
        "done": ("EXECUTED", False, True),
        "absolute": ("EXECUTED", False, True),
        "moved": ("EXECUTED", True, False),
        "late": ("EXECUTED", True, False),
        "again": ("VERIFIED", False, True),
        "again_moved": ("REPRODUCED", True, False),
        "begun": ("DECLARED", True, False),
        "old": ("DECLARED", True, False),
        "gone": ("DECLARED", True, False),
    }
    assert {g for g, *_ in got.values()} == set(GRADES)
    gone, n = grading.vanished(spark, str(tmp_path))
    assert {r.path: r.regenerate for r in gone.collect()} == {"results/gone": "snakemake results/gone", long: f"snakemake {long}"}
    assert n == 11
    assert store.run_record(spark, str(tmp_path), "results/done")["rule"] == "r" and store.run_record(spark, str(tmp_path), "results/absolute")
    assert store.run_record(spark, str(tmp_path), "results/none") is None
    report = grading.report(spark, str(tmp_path))
    assert report["files"] == 10 and report["quotable"] == 2 and report["by_grade"]["EXECUTED"] == 6


def test_an_empty_store_compares_nothing(spark, tmp_path):
    put(tmp_path, "results/a", "a")
    gone, n = grading.vanished(spark, str(tmp_path))
    assert (gone.count(), n) == (0, 0) and store.records(spark, str(tmp_path)).count() == 0


def test_a_stream_of_logs_stops_at_a_bad_line(spark, tmp_path):
    from attest.streaming import joblog

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD | {"id": "k"}) + "\n")

    def run(name):
        q = joblog.by_verdict(joblog.records(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.verdict: r.n for r in spark.table(name).collect()}

    assert run("good_jobs") == {"agrees": 2}
    (tmp_path / "in" / "b.jsonl").write_text('{"id": "z", "ques\n')
    q = joblog.records(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("bad_jobs").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="not json"):
        q.awaitTermination()


def test_long_reports_are_written_by_the_executors(spark, tmp_path, monkeypatch):
    from attest import session

    df = spark.range(30).selectExpr("id", "cast(id as string) as path")
    assert session.listed(df, None, "things", 30)[3] == {"id": 3, "path": "3"}
    with pytest.raises(AttestError, match="more than 29 things"):
        session.listed(df, None, "things", 29)
    told = session.listed(df, str(tmp_path), "things", 29)
    assert told == {"written_to": f"{tmp_path}/things", "rows": 30} and spark.read.json(told["written_to"]).count() == 30


def test_one_record_is_found_by_its_name(spark, tmp_path):
    top = tmp_path / ".snakemake/metadata"
    top.mkdir(parents=True)
    for key in ("results/a.csv", str(tmp_path / "results/b.csv"), "results/" + "long" * 40):
        name = base64.urlsafe_b64encode(key.encode()).decode()
        folder = top
        while len(name) > 100:
            folder, name = folder / f"@{name[:50]}", name[50:]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps({"rule": key[-5:]}))
    (top / "bm90IGpzb24=").write_text("not json")
    assert run_record(spark, str(tmp_path), "results/a.csv")["rule"] == "a.csv"
    assert run_record(spark, str(tmp_path), str(tmp_path / "results/a.csv"))["rule"] == "a.csv"
    assert run_record(spark, str(tmp_path), "results/b.csv")["rule"] == "b.csv"
    assert run_record(spark, str(tmp_path), "results/" + "long" * 40)["rule"] == "glong"
    assert run_record(spark, str(tmp_path), "results/c.csv") is None and run_record(spark, str(tmp_path), "not json") is None
