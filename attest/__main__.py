"""``python -m attest check|belief|grade|emit|figures|conform|selftest|scaffold ...``: exit codes tell what was found."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from .errors import AttestError
from .session import session


def _write(path: str | None, text: str) -> None:
    if path is None:
        sys.stdout.write(text)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def _json(value: object) -> str:
    return json.dumps(value, indent=2, default=str) + "\n"


def _check(spark, a) -> int:
    from .plans.check import check, summary

    report = check(spark, a.root, a.mode)
    print("\n".join(summary(report)))
    _write(a.out or os.path.join(a.root, "results/claims.json"), _json(report.as_dict()))
    return 0


def _belief(spark, a) -> int:
    from .plans.beliefs import load

    report = load(spark, a.root).report()
    for name, found in report["caveats"].items():
        print(f"{name}: {len(found)} caveats")
        for c in found:
            print(f"    [{c['status']}] {c['claim']}" + (f"  note: {c['note']}" if c["note"] else ""))
    for q in report["open_questions"]:
        print(f"open: [{q['status']}] {q['claim']}")
    _write(a.out or os.path.join(a.root, "results/belief.json"), _json(report))
    return 0


def _grade(spark, a) -> int:
    from .plans import grading

    if a.vanished:
        gone, n = grading.vanished(spark, a.root)
        rows = gone.collect()
        for r in rows:
            print(f"gone: {r.path}, made by rule {r.rule}" + (f"; {r.regenerate}" if r.regenerate else ""))
        print(f"{len(rows)} of {n} recorded outputs are gone" if n else "no output is on record, so nothing was compared")
        return 1 if rows or not n else 0
    report = grading.report(spark, a.root, a.paths or None, a.reproduced or (), f"{a.json}.d" if a.json else None)
    if "written_to" in report["grades"]:
        print(f"{report['grades']['rows']} grades are in {report['grades']['written_to']}")
    for path, g in report["grades"].items() if "written_to" not in report["grades"] else ():
        print(f"{g['grade']:<11}{'stale ' if g['stale'] else '      '}{path}: {g['why']}")
    print(f"{report['quotable']} of {report['files']} quotable: {report['by_grade']}")
    if a.json:
        _write(a.json, _json(report))
    return 1 if a.check and report["quotable"] < report["files"] else 0


def _emit(spark, a) -> int:
    from .sinks import croissant, registry
    from .sinks.project import Project

    if a.list or not a.format:
        for name, what in sorted(registry.available().items()):
            print(f"{name:<12}{what}")
        return 0
    if a.format == "croissant":
        text = croissant.render(Project(spark, a.root), str(Path(a.out).parent) if a.out else None)
    else:
        text = registry.emit(spark, a.format, a.root)
    _write(a.out, text)
    return 0


def _figures(spark, a) -> int:
    from .plans.check import check
    from .sinks.figures import build

    index = build(check(spark, a.root), a.out)
    print(f"{len(index)} claims in {a.out}")
    return 0


def _conform(spark, a) -> int:
    from .plans.conform import as_text, sweep

    report = sweep(spark, a.root)
    print(_json(report) if a.json else as_text(report))
    return 1 if report["by_status"].get("FAIL", 0) + report["by_status"].get("UNKNOWN", 0) else 0


def _selftest(spark, a) -> int:
    from .plans.selftest import run

    tried = run(spark)
    for what, right in tried:
        print(f"{'ok' if right else 'WRONG':<6}{what}")
    return 0 if all(right for _, right in tried) else 1


def _scaffold(spark, a) -> int:
    from .sinks.scaffold import scaffold

    d = scaffold(spark, a.directory, a.data, force=a.force)
    print(f"{d['directory']}: {len(d['datasets'])} datasets, {d['rows']} rows, {d['columns']} columns; {len(d['undeclared_units'])} numeric columns wait for a unit, and no claim is made")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="attest", description="Check claims about data by recomputing them.")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        p = commands.add_parser(name)
        for names, options in arguments:
            p.add_argument(*names, **options)
        p.set_defaults(run=run)

    root = (("root",), {"nargs": "?", "default": "."})
    out = (("out",), {"nargs": "?"})
    command("check", _check, root, out, (("--mode",), {"default": "auto", "choices": ["auto", "hash", "mt19937", "poisson"]}))
    command("belief", _belief, root, out)
    command("grade", _grade, root, (("paths",), {"nargs": "*"}), (("--check",), {"action": "store_true"}), (("--vanished",), {"action": "store_true"}), (("--reproduced",), {"nargs": "*"}), (("--json",), {}))
    command("emit", _emit, (("format",), {"nargs": "?"}), root, out, (("--list",), {"action": "store_true"}))
    command("figures", _figures, (("root",), {}), (("out",), {}))
    command("conform", _conform, root, (("--json",), {"action": "store_true"}))
    command("selftest", _selftest)
    command("scaffold", _scaffold, (("directory",), {}), (("data",), {"nargs": "+"}), (("--force",), {"action": "store_true"}))
    a = top.parse_args(argv)
    spark = session(os.environ.get("ATTEST_MASTER", "local[*]"))
    try:
        return a.run(spark, a)
    except AttestError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
