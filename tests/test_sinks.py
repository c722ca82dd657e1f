"""Everything that is written: read back, resolved, refused where it would mislead."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attest.__main__ import main
from attest.errors import PublishError
from attest.plans.check import check, summary
from attest.plans.conform import as_text, classify, sweep, tokens
from attest.sinks import catalogue, crate, croissant, figures, graph, prov, registry, scaffold
from attest.sinks.project import Project
from attest.sinks.triples import Statements, challenged, evidence_paths, here, iri, ntriples, turtle

CONTEXT = """
[project]
name = "p"
title = "A project"
license = "https://example.org/license"
version = "1"
date_published = "2024-01-01"
keywords = ["k"]
publisher = "Us"
[[datasets]]
id = "d"
origin = "computed"
files = ["data/d.csv"]
title = "Rows"
[[variables]]
dataset = "d"
name = "x"
unit = "1"
description = "first"
[[variables]]
dataset = "d"
name = "y"
unit = "nm"
[[relationships]]
x = "d.x"
y = "d.y"
kind = "correlation"
method = "pearson"
claimed = 0.9
[relationships.evidence]
source = "A paper. It says so. And more"
locator = "p. 3"
[belief.rests_on]
d = "a"
[[belief.nodes]]
id = "a"
kind = "quantity"
[[belief.nodes]]
id = "b"
kind = "reference"
[[belief.claims]]
subject = "a"
predicate = "approximates"
object = "b"
tested_by = "d.x ~ d.y"
[jobs]
records = "jobs.jsonl"
agent = "me"
[psdi]
landing_page = "https://example.org/"
access_rights = "Open"
contact_point = "mailto:a@example.org"
creators = [{name = "A B"}, {orcid = "0000-0001"}]
"""


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    (top / "data").mkdir()
    r = random.Random(2)
    (top / "data/d.csv").write_text("x,y\n" + "".join(f"{r.random():.3f},{r.random():.3f}\n" for _ in range(50)))
    (top / "context.toml").write_text(CONTEXT)
    job = {"id": "j1", "question": "q", "expected": ["a b"], "verdict": "agrees", "generated": ["a b"], "started": "2024-01-01T00:00:00", "ended": "yesterday"}
    (top / "jobs.jsonl").write_text(json.dumps(job) + "\n" + json.dumps({"id": "j2", "question": "q"}) + "\n")
    report = check(spark, str(top), replicates=100)
    (top / "results").mkdir()
    (top / "results/claims.json").write_text(json.dumps(report.as_dict()))
    return top


def test_every_format_is_written(spark, root):
    for name in registry.BUILT_IN:
        assert registry.emit(spark, name, str(root))
    assert set(registry.available()) >= set(registry.BUILT_IN)
    with pytest.raises(PublishError, match="no format"):
        registry.get("pdf")


def test_croissant_reads_from_where_it_stands(spark, root):
    p = Project(spark, str(root))
    card = croissant.build(p, str(root / "results"))
    assert card["distribution"][0]["contentUrl"] == "../data/d.csv"
    assert (root / "results" / card["distribution"][0]["contentUrl"]).is_file()
    fields = {f["name"]: f for f in card["recordSet"][0]["field"]}
    assert fields["x"]["dataType"] == "sc:Float" and fields["y"][f"{croissant.NS}unit"] == "nm"
    assert card[f"{croissant.NS}claims"][0]["verdict"] == "refuted"


def test_turtle_parses_and_says_everything(spark, root):
    p = Project(spark, str(root))
    for text in (graph.render(p), catalogue.render_dcat(p), catalogue.render_psdi(p), prov.render(p), prov.render_axioms()):
        assert tokens(text) is not None
    s = Statements()
    s.say("at:a", "rdfs:label", 'say "hi"\n\\')
    s.say("at:a", "at:n", 3, "xsd:integer")
    s.say("at:a", "at:none", None)
    s.link("at:a", "rdf:type", "at:T")
    assert len(s.rows()) == 3 and tokens(turtle(s.rows())) is not None and '"say \\"hi\\"\\n\\\\"' in turtle(s.rows())
    assert ntriples(s.table(spark)).filter("value like '%\"3\"^^<%integer> .'").count() == 1


def test_graph_reaches_from_evidence_to_bytes_and_from_verdicts_to_tables(spark, root):
    t = graph.build(Project(spark, str(root)))
    paths = evidence_paths(t).collect()
    assert {r.locator for r in paths} == {"p. 3"} and len(paths) == 2
    hit = {r.target.rsplit("/", 2)[-2] + "/" + r.target.rsplit("/", 1)[-1] for r in challenged(t).collect()}
    assert hit == {"claim/1", "node/a", "artefact/d"}


def test_prov_keeps_intent_and_fact_apart(spark, root):
    t = prov.statements(prov.JobLog.of_project(spark, str(root)).jobs)
    by = lambda p: [(r.s, r.o, r.datatype) for r in t.filter(t.p == iri(p)).collect()]
    assert len(by("dct:requires")) == 1 and len(by("prov:generated")) == 1 and len(by("prov:hadPlan")) == 1
    assert by("prov:startedAtTime")[0][2] == iri("xsd:dateTime") and by("prov:endedAtTime")[0][2] is None


def test_psdi_has_what_the_profile_wants_and_refuses_what_it_cannot_carry(spark, root, tmp_path):
    p = Project(spark, str(root))
    found = catalogue.shape_findings(catalogue.psdi(p))
    assert found["real"] == [] and len(found["exempt"]) == 3
    assert not any("checksum" in r[1] for r in catalogue.psdi(p).rows())
    for change, words in [(("Open", "secret"), "access_rights"), (('contact_point = "mailto:a@example.org"', 'contact_name = "A"'), "contact_url")]:
        (tmp_path / "context.toml").write_text(CONTEXT.replace(*change))
        (tmp_path / "data").mkdir(exist_ok=True)
        with pytest.raises(PublishError, match=words):
            catalogue.psdi(Project(spark, str(tmp_path)))


def test_an_exemption_covers_a_missing_value_only(spark, root, tmp_path):
    ds, p = here("dataset/p"), Project(spark, str(root))
    record = catalogue.psdi(p)
    ds = next(s for s, t, o, *_ in record.rows() if o == iri("dcat:Dataset"))
    less = catalogue.shape_findings(record, tuple(x for x in catalogue.EXEMPT if "Identifier" not in x))
    assert len(less["exempt"]) == 2 and "IdentifierPropertyShape" in less["real"][0]
    for term, value, kind, words in [
        ("dct:identifier", "https://resources.psdi.ac.uk/data/definitely-not", "xsd:string", "an exemption is for a missing one"),
        ("dct:accessRights", "https://example.org/own", None, "is not allowed"),
        ("dct:issued", "soon", "xsd:string", "is no xsd:dateTime"),
        ("dct:title", "another", "xsd:string", "said 2 times"),
        ("foaf:name", "n", "xsd:string", "may not say"),
    ]:
        record = catalogue.psdi(p)
        record.say(ds, term, value, kind) if kind else record.link(ds, term, value)
        assert any(words in x for x in catalogue.shape_findings(record)["real"]), term
    (tmp_path / "context.toml").write_text(CONTEXT.replace("keywords", "no_keywords"))
    (tmp_path / "data").mkdir()
    assert "none is made up" in catalogue.shape_findings(catalogue.psdi(Project(spark, str(tmp_path))))["real"][0]


def test_conformance_keeps_two_verdicts_apart(spark, root, tmp_path):
    for d in ("data", "results"):
        (tmp_path / d).mkdir()
    (tmp_path / "data/d.csv").write_text((root / "data/d.csv").read_text())
    card = croissant.render(Project(spark, str(root)))
    (tmp_path / "card.json").write_text(card)
    (tmp_path / "results/card.jsonld").write_text(card)
    (tmp_path / "cut.json").write_text('{"recordSet": [')
    (tmp_path / "other.json").write_text('{"a": 1}')
    (tmp_path / "list.json").write_text('[{"@type": "http://mlcommons.org/croissant/x"}]')
    (tmp_path / "dcat.ttl").write_text(catalogue.render_dcat(Project(spark, str(root))))
    (tmp_path / "bad.ttl").write_text("@prefix dcat: <http://www.w3.org/ns/dcat#> .\n dcat:x { } ")
    crate.write(spark, str(tmp_path))
    got = sweep(spark, str(tmp_path))
    at = {Path(f["path"]).relative_to(tmp_path).as_posix(): (f["kind"], f["validates"], f["reads"], f["status"]) for f in got["findings"]}
    assert at["card.json"] == ("croissant", "PASS", "PASS", "PASS")
    assert at["results/card.jsonld"] == ("croissant", "PASS", "FAIL", "FAIL") and got["validated_but_unreadable"] == 1
    assert at["cut.json"] == ("?", "UNKNOWN", "UNKNOWN", "UNKNOWN")
    assert at["dcat.ttl"][2] == "PASS" and at["bad.ttl"][1] == "FAIL" and at["ro-crate-metadata.json"][2] == "PASS"
    assert [Path(f["path"]).name for f in got["skipped"]] == ["other.json"]
    assert "cannot be read" in as_text(got)
    (tmp_path / "data/d.csv").write_text("x,y\n1,2\n")
    assert {f["reads"] for f in sweep(spark, str(tmp_path))["findings"] if f["kind"] == "ro-crate"} == {"FAIL"}
    assert "nothing was examined" in as_text(sweep(spark, str(tmp_path / "absent")))
    assert sweep(spark, str(tmp_path / "other.json"))["target"] == "file"


def test_classification_is_by_content():
    assert classify("x.json", '{"@graph": [{"@id": "./"}, {"@id": "ro-crate-metadata.json", "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}}]}')[:2] == ("ro-crate", "1.1")
    assert classify("x.json", '{"conformsTo": "http://mlcommons.org/croissant/1.1"}')[:2] == ("croissant", "1.1")
    assert classify("x.json", '{"recordSet": []}')[:2] == ("croissant", "(undeclared)")
    assert classify("x.json", "[" * 100_000)[3] and classify("x.json", "3")[:2] == ("?", "")
    assert classify("x.ttl", "<http://metadata.psdi.ac.uk/> <http://www.w3.org/ns/dcat#x>")[:2] == ("dcat", "psdi")


def test_crates(spark, root, tmp_path):
    with pytest.raises(PublishError, match="is called"):
        crate.write(spark, str(root), str(root / "x.json"))
    with pytest.raises(PublishError, match="belongs into"):
        crate.write(spark, str(root), str(tmp_path / crate.NAME))
    doc = crate.build(spark, str(root), exclude=("jobs.jsonl",))
    names = {e["@id"] for e in doc["@graph"] if e["@type"] == "File"}
    assert "data/d.csv" in names and "jobs.jsonl" not in names and crate.root_of(doc)["name"] == "A project"
    with pytest.raises(PublishError, match="no root"):
        crate.root_of({"@graph": []})


def test_figures_show_the_points_that_were_judged(spark, root, tmp_path):
    report = check(spark, str(root), replicates=100)
    (entry,) = figures.build(report, str(tmp_path), draw=False)
    assert entry["n_points"] == 50 and entry["verdict"] == "refuted" and "A paper. It says so." in entry["caption"]
    assert json.loads((tmp_path / "index.json").read_text())[0]["id"] == "claim_1"
    assert spark.read.parquet(str(tmp_path / entry["points"])).count() == 50
    assert len(summary(report)) == 1


def test_captions(spark):
    schema = "id string, x string, y string, x_dataset string, y_dataset string, method string, evidence map<string,string>, claimed double, estimate double, ci_lo double, ci_hi double, ci_level double, n_units long, resampling_unit string, n_rows long, dropped long, verdict string, why string"
    rows = [
        ("near", "a.x", "b.y", "b", "a", "pearson", {"source": "One is said. Two  too. Not three."}, 0.5, 0.50001, 0.50001, 0.6, 0.9, 3, "g", 10, 2, "refuted", "w"),
        ("bare", "a.x", "a.y", "a", "a", "spearman", None, -0.5, 0.25, None, None, None, 2, None, 10, 0, "unverifiable", "no interval"),
        ("none", "a.x", "a.y", "a", None, "pearson", {}, 0.0, None, None, None, None, None, None, None, None, "unverifiable", "word " * 40),
    ]
    said = {r.id: r.caption.split("\n") for r in figures.captions(spark.createDataFrame(rows, schema), {"a": ("data/a.csv", "data/c.csv")}).collect()}
    assert said["near"] == [
        "near", "One is said. Two too.", "claimed +0.50; found pearson +0.500 (+1.00e-05 from the claim), 90% interval +0.500 to +0.600, 3 x g, R2 0.250",
        "REFUTED: w", "10 rows, 2 dropped; a from data/a.csv, data/c.csv; b",
    ]
    assert said["bare"][1:3] == ["a.x and a.y", "claimed -0.50; found spearman +0.250, no interval, 2 x row"]
    assert said["none"][2] == "claimed +0.00; not measured" and all(len(x) <= figures.LINE for x in said["none"]) and len(said["none"]) == 6
    more = spark.createDataFrame([(*rows[0], 1e-5, 1e-4, 0.3, "pose")], schema + ", p_value double, p_floor double, r_squared double, level string")
    (r,) = figures.captions(more).collect()
    assert "p below 1.0e-04, R2 0.300" in r.caption.replace("\n", " ") and "level pose" in r.caption
    (r,) = figures.captions(more.withColumn("p_value", F.lit(0.02))).collect()
    assert "p 2.00e-02" in r.caption.replace("\n", " ")
    assert spark.range(1).select(figures.formatted(F.lit(float("nan"))).alias("v")).first().v == "n/a"


def test_scaffold_makes_a_project_that_checks(spark, tmp_path):
    (tmp_path / "A b.csv").write_text('k,"v ""q"" \\ nm",t\n1,2.5,\n2,3.5,\n')
    (tmp_path / "c.csv").write_text("k,w\n1,5\n")
    made = scaffold.scaffold(spark, str(tmp_path / "new"), [str(tmp_path / "A b.csv"), str(tmp_path / "c.csv")])
    assert (made["rows"], made["columns"], made["numeric_columns"]) == (3, 5, 4) and made["datasets"][0]["id"] == "a_b"
    text = (tmp_path / "new/context.toml").read_text()
    assert "EMPTY" in text and '# join = "k"' in text
    assert check(spark, str(tmp_path / "new")).as_dict()["rows_read"] == 3
    with pytest.raises(PublishError, match="not empty"):
        scaffold.scaffold(spark, str(tmp_path / "new"), [str(tmp_path / "c.csv")])
    assert scaffold.unique("a", taken := {"a", "a_2"}) == "a_3" and "a_3" in taken
    for name, body, words in [("e", "", "empty"), ("s", "a;b\n1;2\n", "commas"), ("n", "a,\n1,2\n", "no name"), ("d", "a,a\n1,2\n", "repeats"), ("h", "a,b\n", "no rows"), ("w", "a,b\n , \n", "no rows")]:
        (tmp_path / f"{name}.csv").write_text(body)
        with pytest.raises(PublishError, match=words):
            scaffold.scaffold(spark, str(tmp_path / "other"), [str(tmp_path / f"{name}.csv")])
    assert not (tmp_path / "other").exists()
    with pytest.raises(PublishError, match="no file"):
        scaffold.scaffold(spark, str(tmp_path / "other"), [str(tmp_path / "zz.csv")])


def test_the_command_line(spark, root, monkeypatch, capsys):
    assert main(["check", str(root), str(root / "results/claims.json")]) == 0
    assert "REFUTED" in capsys.readouterr().out
    assert main(["belief", str(root)]) == 0 and (root / "results/belief.json").is_file()
    assert main(["emit", "croissant", str(root), str(root / "results/croissant.json")]) == 0
    assert main(["emit", "--list"]) == 0 and main(["emit", "pdf", str(root)]) == 2
    assert main(["conform", str(root)]) == 0
    # Nothing here can judge a catalogue record, which is no pass.
    assert main(["emit", "dcat", str(root), str(root / "results/record.ttl")]) == 0 and main(["conform", str(root)]) == 1
    (root / "results/record.ttl").unlink()
    assert main(["grade", str(root), "--check"]) == 1 and main(["grade", str(root), "--vanished"]) == 1


def test_the_checks_tell_right_from_wrong(spark, capsys, monkeypatch):
    assert main(["selftest"]) == 0 and "WRONG" not in capsys.readouterr().out
    monkeypatch.setattr("attest.plans.selftest.card_faults", lambda doc: [])
    assert main(["selftest"]) == 1 and "WRONG a card without a digest does not" in capsys.readouterr().out
