"""Closures, caveats and refusals; every predicate and status by the vocabulary."""

from __future__ import annotations

import json
import random

import pytest

from attest.catalog import parse
from attest.errors import BeliefError
from attest.functions.vocabulary import PREDICATES, STATUSES
from attest.operators.belief import CLAIMS, NODES, RESTS_ON, BeliefGraph
from attest.operators import closure as closure_module
from attest.operators.closure import closure, reachable
from attest.plans.beliefs import load, tables


def graph(spark, claims, rests=(), names=None, driver_edges=2000):
    """claims: (subject, predicate, object, status[, evidence])."""
    rows = []
    for i, c in enumerate(claims):
        needs = STATUSES.get(c[3], (False,))[0]
        rows.append((i, *c[:4], c[4] if len(c) > 4 else "seen" if needs else "", None, None, ""))
    names = names or sorted({n for c in claims for n in (c[0], c[2])})
    return BeliefGraph(spark.createDataFrame([(n, "method", "") for n in names], NODES), spark.createDataFrame(rows, CLAIMS), spark.createDataFrame(list(rests), RESTS_ON), driver_edges)


def test_every_predicate_spreads_as_the_vocabulary_says(spark):
    claims = [(f"a{i}", p, f"b{i}", "assumed") for i, p in enumerate(PREDICATES)]
    g = graph(spark, claims, [(f"on_{n}{i}", f"{n}{i}") for i in range(len(PREDICATES)) for n in "ab"])
    stale = {(r.changed, r.goes_stale) for r in g.stale_table().collect()}
    doubt = {(r.node, r.rests_on) for r in g.doubt_table().collect()}
    given = {r.artefact for r in g.all_caveats.collect()}
    for i, (direction, kind, _) in enumerate(PREDICATES.values()):
        a, b = f"a{i}", f"b{i}"
        assert ((b, a) in stale, (a, b) in stale) == (direction == "backward", direction == "forward")
        assert ((a, b) in doubt, (b, a) in doubt) == (kind in ("to_subject", "both_ways"), kind in ("to_object", "both_ways"))
        assert (f"on_{a}" in given, f"on_{b}" in given) == (kind != "to_object", kind != "to_subject")


def test_every_status_asks_and_warns_as_the_vocabulary_says(spark):
    g = graph(spark, [(f"s{i}", "approximates", "o", s) for i, s in enumerate(STATUSES)], [(f"t{i}", f"s{i}") for i in range(len(STATUSES))])
    asked = {r.status for r in g.open_questions().collect()}
    warned = {r.status for r in g.all_caveats.collect()}
    assert asked == {s for s, (_, q, _) in STATUSES.items() if q} and warned == {s for s, (*_, c) in STATUSES.items() if c}


@pytest.mark.parametrize("driver_edges", [2000, 0])
def test_cycles_and_loops_end(spark, driver_edges):
    g = graph(spark, [("a", "depends_on", "b", "measured"), ("b", "depends_on", "a", "measured"), ("c", "depends_on", "c", "measured"), ("c", "depends_on", "a", "measured")], driver_edges=driver_edges)
    assert g.stale_if("a") == ["b", "c"] and g.stale_if("c") == [] and g.in_doubt("c") == ["a", "b"]


def test_doubt_crosses_one_peer_edge_only(spark):
    g = graph(spark, [("a", "shares_approximation_with", "b", "assumed"), ("b", "shares_approximation_with", "c", "assumed"), ("c", "approximates", "d", "assumed"), ("x", "depends_on", "a", "measured")])
    assert g.in_doubt("a") == ["b"] and g.in_doubt("b") == ["a", "c"] and g.in_doubt("x") == ["a", "b"]
    assert [(r.supporter, r.supported) for r in g.supports_edges().collect()] == [("a", "x"), ("d", "c")]


def test_caveats_say_by_which_root_they_came(spark):
    g = graph(spark, [("a", "depends_on", "m", "measured"), ("b", "depends_on", "m", "measured"), ("m", "approximates", "z", "falsified")], [("r", "a"), ("r", "b"), ("clean", "z")])
    (c,) = g.caveats_on("r").collect()
    assert c.via == ["a", "b"] and c.status == "falsified" and c.claim == "m --approximates--> z"
    assert g.caveats_on("clean").count() == 0 and g.knows("clean") and not g.knows("nobody")
    s = g.summary().first()
    assert (s.caveats, s.caveat_deliveries, s.caveats_undeliverable, s.artefacts) == (1, 1, 0, 2)
    lost = graph(spark, [("m", "approximates", "z", "falsified")]).summary().first()
    assert (lost.caveats, lost.caveats_undeliverable) == (0, 1)


def test_contradictions_and_report(spark):
    g = graph(spark, [("a", "approximates", "b", "measured"), ("a", "approximates", "b", "falsified"), ("a", "depends_on", "b", "measured")], [("r", "a")])
    (c,) = g.contradictions().collect()
    assert c.statuses == ["falsified", "measured"]
    report = g.report()
    assert json.dumps(report) and report["summary"]["by_status"] == {"falsified": 1, "measured": 2}


@pytest.mark.parametrize(
    ("claim", "words"),
    [
        (("a", "likes", "b", "measured"), "no predicate"),
        (("a", "approximates", "b", "rumoured"), "no status"),
        (("a", "approximates", "b", "measured", " "), "needs evidence"),
        (("a", "approximates", "b", "untested", "seen"), "no evidence"),
        (("a", "approximates", "c", "assumed"), "no node"),
    ],
)
def test_claims_are_refused(spark, claim, words):
    with pytest.raises(BeliefError, match=words):
        graph(spark, [claim], names=["a", "b"])


def test_nodes_roots_and_repeats_are_refused(spark):
    ok = [("a", "approximates", "b", "assumed")]
    with pytest.raises(BeliefError, match="no node"):
        graph(spark, ok, [("r", "q")])
    with pytest.raises(BeliefError, match="same"):
        graph(spark, ok * 2)
    with pytest.raises(BeliefError, match="no known kind"):
        BeliefGraph(spark.createDataFrame([("a", "thing", "")], NODES), spark.createDataFrame([], CLAIMS), spark.createDataFrame([], RESTS_ON))
    with pytest.raises(BeliefError, match="two nodes"):
        graph(spark, ok, names=["a", "a", "b"])
    with pytest.raises(BeliefError, match="no node"):
        graph(spark, ok).stale_if("q")


def test_both_closures_agree_on_random_graphs(spark):
    for seed in range(2):
        r = random.Random(seed)
        edges = spark.createDataFrame([(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(35)], "src string, dst string")
        a, b = (sorted(map(tuple, closure(edges, driver_edges=n).collect())) for n in (1000, 0))
        assert a == b
        assert [x.dst for x in reachable(edges, "n1", 0).collect()] == sorted(d for s, d in a if s == "n1")
    assert closure(spark.createDataFrame([], "src string, dst string"), driver_edges=0).count() == 0


CONTEXT = {"nodes": [{"id": n, "kind": "method"} for n in "ab"], "rests_on": {"t": "a"}, "claims": [{"subject": "a", "predicate": "approximates", "object": "b", "tested_by": "x ~ y"}]}
VERDICT = {"x": "x", "y": "y", "status": "falsified", "why": "it is outside"}


def _load(spark, belief, *verdicts):
    return load(spark, parse({"project": {"name": "p"}, "belief": belief}), {"relationships": list(verdicts)})


def test_verdicts_settle_claims(spark):
    g = _load(spark, CONTEXT, VERDICT)
    assert g.claims.first().status == "falsified" and g.claims.first().evidence == "it is outside"
    assert _load(spark, CONTEXT, VERDICT | {"status": "untested"}).claims.first().evidence == ""
    by_id = CONTEXT | {"claims": [CONTEXT["claims"][0] | {"tested_by": "v1"}]}
    assert _load(spark, by_id, VERDICT | {"id": "v1"}, VERDICT | {"id": "v2"}).claims.first().status == "falsified"
    for verdicts, words in [((), "no such verdict"), ((VERDICT, VERDICT), "several"), ((VERDICT | {"id": "i"}, VERDICT | {"id": "i"}), "two verdicts")]:
        with pytest.raises(BeliefError, match=words):
            _load(spark, CONTEXT, *verdicts)
    with pytest.raises(BeliefError, match="only one"):
        _load(spark, CONTEXT | {"claims": [CONTEXT["claims"][0] | {"status": "assumed"}]}, VERDICT)


def test_declarations_are_refused(spark):
    for claims, words in [([{"subject": "a"}], "lacks"), ([CONTEXT["claims"][0] | {"defined_in": "q"}], "only one"), ([{"subject": "a", "predicate": "approximates", "object": "b"}], "no status")]:
        with pytest.raises(BeliefError, match=words):
            tables(spark, CONTEXT | {"claims": claims})
    with pytest.raises(BeliefError, match="declares no"):
        load(spark, parse({"project": {"name": "p"}}))


def test_claims_of_a_sibling(spark, tmp_path):
    def put(name, claims):
        (tmp_path / name).mkdir(exist_ok=True)
        text = f'[project]\nname = "{name}"\n[belief.rests_on]\nt = "a"\n' + "".join(f'[[belief.nodes]]\nid = "{n}"\nkind = "method"\n' for n in "ab") + claims
        (tmp_path / name / "context.toml").write_text(text)
        return str(tmp_path / name)

    one = '[[belief.claims]]\nsubject = "a"\npredicate = "approximates"\nobject = "b"\n'
    put("owner", one + 'status = "falsified"\nevidence = "e"\n')
    mine = put("mine", one + 'defined_in = "owner"\nnote = "ours"\n')
    c = load(spark, mine).claims.first()
    assert (c.status, c.evidence, c.note, c.defined_in) == ("falsified", "e", "ours", "owner")
    with pytest.raises(BeliefError, match="imports claims itself"):
        load(spark, put("third", one + 'defined_in = "mine"\n'))
    with pytest.raises(BeliefError, match="makes no claim"):
        load(spark, put("fourth", one.replace("approximates", "depends_on") + 'defined_in = "owner"\n'))
    with pytest.raises(BeliefError, match="fifth"):
        load(spark, put("sixth", one + 'defined_in = "fifth"\n'))
    put("owner", one + 'status = "falsified"\nevidence = "e"\n' + one + 'status = "assumed"\n')
    with pytest.raises(BeliefError, match="several statuses"):
        load(spark, mine)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = closure_module.settled
    monkeypatch.setattr(closure_module, "settled", lambda df: rounds.append(1) or plain(df))
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("n120", "n118")], "src string, dst string")
    found = {tuple(r) for r in closure_module.closure(chain, driver_edges=0).collect()}
    want = {(f"n{i:03}", f"n{j:03}") for i in range(121) for j in range(i + 1, 121)} | {("n120", "n118"), ("n120", "n119"), ("n119", "n118")}
    assert found == want and len(rounds) <= 11


def test_many_pairs_of_few_edges_are_not_closed_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(closure_module, "DRIVER_PAIRS", 10)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")], "src string, dst string")
    found = closure_module.closure(edges)
    assert {tuple(r) for r in found.collect()} == {(x, y) for x in "abcde" for y in "abcde" if x != y}
    seeds = spark.createDataFrame([("a",)], "src string")
    assert {tuple(r) for r in closure_module.closure(edges, seeds).collect()} == {("a", y) for y in "bcde"}


@pytest.mark.parametrize("with_seeds", [False, True])
def test_three_ways_give_the_same_pairs(spark, monkeypatch, with_seeds):
    r = random.Random(4)
    rows = [(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(70)] + [("v1", None), (None, "v2"), ("a", "a")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    seeds = spark.createDataFrame([("v1",), ("v2",), ("absent",), ("v1",), ("a",)], "src string") if with_seeds else None
    monkeypatch.setattr(closure_module, "WALKED", 10)
    ways = [{tuple(x) for x in closure_module.closure(edges, seeds, **how).collect()} for how in ({}, {"driver_edges": 1}, {"driver_edges": 0})]
    assert ways[0] == ways[1] == ways[2] and ways[0]
