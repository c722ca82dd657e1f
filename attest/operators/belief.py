"""What rests on what: two closures over typed claims, and the caveats that they deliver.

Change spreads by staleness: a predicate says which end goes stale when the other changes.  Doubt spreads otherwise:
along rests-on edges any number of times, then across one symmetric peer edge and no further.  Tables:

    nodes(id, kind, label)
    claims(idx, subject, predicate, object, status, evidence, tested_by, defined_in, note)
    rests_on(artefact, node)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BeliefError
from ..functions import vocabulary
from ..session import small_table
from .closure import DRIVER_EDGES, closure
from .durable import compact

NODES = "id string, kind string, label string"
CLAIMS = "idx int, subject string, predicate string, object string, status string, evidence string, tested_by string, defined_in string, note string"
RESTS_ON = "artefact string, node string"


def display(subject: str = "subject", predicate: str = "predicate", obj: str = "object") -> Column:
    return F.concat(F.col(subject), F.lit(" --"), F.col(predicate), F.lit("--> "), F.col(obj))


def described(claims: DataFrame) -> DataFrame:
    """claims with the flags of their status and the directions of their predicate, from two broadcast tables of fixed
    size."""
    spark = claims.sparkSession
    return claims.join(F.broadcast(vocabulary.statuses(spark)), "status", "left").join(F.broadcast(vocabulary.predicates(spark)), "predicate", "left")


def stale_edges(claims: DataFrame) -> DataFrame:
    """(src, dst): dst goes stale when src changes."""
    at = described(claims).filter("stale is not null")
    back = F.col("stale") == "backward"
    return at.select(F.when(back, F.col("object")).otherwise(F.col("subject")).alias("src"), F.when(back, F.col("subject")).otherwise(F.col("object")).alias("dst")).distinct()


def rest_edges(claims: DataFrame) -> DataFrame:
    """(src, dst): src rests on dst, so doubt about dst reaches src."""
    at = described(claims).filter(F.col("doubt").isin("to_subject", "to_object"))
    down = F.col("doubt") == "to_subject"
    return at.select(F.when(down, F.col("subject")).otherwise(F.col("object")).alias("src"), F.when(down, F.col("object")).otherwise(F.col("subject")).alias("dst")).distinct()


def peer_edges(claims: DataFrame) -> DataFrame:
    """(src, dst), both ways."""
    at = described(claims).filter("doubt = 'both_ways'").select("subject", "object")
    return at.select(F.col("subject").alias("src"), F.col("object").alias("dst")).union(at.select("object", "subject")).distinct()


def doubt_reach(claims: DataFrame, starts: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(src, dst) for starts(src): all that src rests on, and the peers of that and of src."""
    claims, starts = compact(claims, driver_edges), compact(starts.select("src").distinct(), driver_edges)
    rests = closure(rest_edges(claims), starts, driver_edges)
    base = rests.union(starts.select("src", F.col("src").alias("dst")))
    peers = peer_edges(claims).select(F.col("src").alias("dst"), F.col("dst").alias("peer"))
    crossed = base.join(peers, "dst").select("src", F.col("peer").alias("dst"))
    return base.union(crossed).filter("src <> dst").distinct()


def bearers(claims: DataFrame) -> DataFrame:
    """(idx, node): whose numbers a claim is about."""
    one = F.when(F.col("doubt") == "to_subject", F.array("subject")).when(F.col("doubt") == "to_object", F.array("object")).otherwise(F.array_distinct(F.array("subject", "object")))
    return described(claims).select("idx", F.explode(one).alias("node"))


def caveats(claims: DataFrame, rests_on: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """artefact, idx, claim, status, via: each claim that carries a caveat and bears on what an artefact rests on, with
    the roots that it came by, in order."""
    claims = compact(claims, driver_edges)
    roots = compact(rests_on.select("artefact", F.col("node").alias("src")).distinct(), driver_edges)
    starts = roots.select("src").distinct()
    reach = doubt_reach(claims, starts, driver_edges).union(starts.select("src", F.col("src").alias("dst")))
    carrying = described(claims).filter("carries_caveat").select("idx", display().alias("claim"), "status", "evidence", "note", "tested_by", "open_question")
    found = roots.join(reach, "src").join(bearers(claims).withColumnRenamed("node", "dst"), "dst").groupBy("artefact", "idx").agg(F.array_sort(F.collect_set("src")).alias("via"))
    return found.join(carrying, "idx").select("artefact", "idx", "claim", "status", "via", "evidence", "note", F.col("tested_by").alias("recomputed_from"), "open_question", vocabulary.status_meaning(F.col("status")).alias("why")).orderBy("artefact", "status", "claim", "idx")


def open_questions(claims: DataFrame) -> DataFrame:
    """Claims that nobody has settled, in the order of declaration, with their predicate's meaning."""
    return described(claims).filter("open_question").select("idx", display().alias("claim"), "status", F.col("meaning").alias("predicate_means"), vocabulary.status_meaning(F.col("status")).alias("why_open"), "note", F.col("tested_by").alias("recomputed_from"), "defined_in").orderBy("idx")


def contradictions(claims: DataFrame) -> DataFrame:
    """Statements that stand with several statuses."""
    each = claims.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("status")).alias("statuses"))  # statuses are seven
    return each.filter(F.size("statuses") > 1).orderBy("subject", "predicate", "object")


def violations(nodes: DataFrame, claims: DataFrame, rests_on: DataFrame) -> DataFrame:
    """(idx, rule, message) of everything that can't be closed over; idx is -1 for nodes and roots."""
    evidence = F.trim(F.coalesce("evidence", F.lit(""))) != ""
    named = lambda c: F.coalesce(F.col(c), F.lit("null"))
    broken = {
        "predicate": (F.col("doubt").isNull(), F.concat(F.lit("no predicate is called "), named("predicate"))),
        "status": (F.col("carries_caveat").isNull(), F.concat(F.lit("no status is called "), named("status"))),
        "evidence_missing": (F.col("evidence_required") & ~evidence, F.concat(F.col("status"), F.lit(" needs evidence"))),
        "evidence_forbidden": ((F.col("status") == "untested") & evidence, F.lit("an untested claim can have no evidence")),
    }
    said = [F.when(when, F.struct(F.lit(rule).alias("rule"), F.concat(display(), F.lit(": "), words).alias("message"))) for rule, (when, words) in broken.items()]
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    ends = claims.select("idx", F.explode(F.array("subject", "object")).alias("_id")).distinct().join(ids, "_id", "left_anti")
    found = [
        described(claims).select("idx", F.inline(F.filter(F.array(*said), lambda x: x.isNotNull()))),
        ends.select("idx", F.lit("node"), F.concat(F.lit("no node is called "), named("_id"))),
        nodes.filter(~F.coalesce(F.col("kind").isin(*vocabulary.NODE_KINDS), F.lit(False))).select(F.lit(-1), F.lit("kind"), F.concat(F.lit("node "), F.col("id"), F.lit(" is of no known kind: "), named("kind"))),
        nodes.groupBy("id").count().filter("count > 1").select(F.lit(-1), F.lit("duplicate_node"), F.concat(F.lit("two nodes are called "), F.col("id"))),
        rests_on.join(ids, rests_on["node"] == ids["_id"], "left_anti").select(F.lit(-1), F.lit("root"), F.concat(F.col("artefact"), F.lit(" rests on "), named("node"), F.lit(", which is no node"))),
        duplicates(claims).select("idx", F.lit("duplicate_claim"), F.concat(F.lit("claims "), F.col("before").cast("string"), F.lit(" and "), F.col("idx").cast("string"), F.lit(" are the same"))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.orderBy("idx", "rule", "message")


def duplicates(claims: DataFrame) -> DataFrame:
    """(before, idx): claims equal in statement, status and evidence, each with the one before."""
    same = Window.partitionBy("subject", "predicate", "object", "status", F.coalesce("evidence", F.lit(""))).orderBy("idx")
    return claims.withColumn("before", F.lag("idx").over(same)).filter("before is not null").select("before", "idx")


def judged_claims(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims with status and evidence of the verdict that ``tested_by`` names, by id or by ``x ~ y``.

    verdicts(id, x, y, status, why).  A verdict's pair is a name only where it is the only one with it.  Claims that
    name none, or one and a status of their own, are refused.
    """
    ids = verdicts.filter("id is not null")
    if again := ids.groupBy("id").count().filter("count > 1").select("id").first():
        raise BeliefError(f"two verdicts are called {again.id!r}")
    pairs = verdicts.withColumn("key", F.concat_ws(" ~ ", "x", "y"))
    counted = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("status", "why")).alias("v"))
    names = ids.select(F.col("id").alias("key"), F.lit(1).cast("long").alias("n"), F.struct("status", "why").alias("v"))
    index = names.union(counted.join(names.select("key"), "key", "left_anti"))
    # An imported claim was judged by its owner.
    own = F.col("tested_by").isNotNull() & F.col("defined_in").isNull()
    tested = claims.filter(own).join(index.select("key", "n", "v"), claims["tested_by"] == index["key"], "left")
    bad = tested.filter("key is null or n > 1 or status is not null or evidence is not null").orderBy("idx").first()
    if bad is not None:
        if bad.status is not None or bad.evidence is not None:
            raise BeliefError(f"claim {bad.idx} is tested by {bad.tested_by!r} and brings a status or evidence of its own; only one can decide")
        raise BeliefError(f"claim {bad.idx} is tested by {bad.tested_by!r}, " + ("which several verdicts share" if bad.n else "and there is no such verdict"))
    # An unverifiable verdict leaves the claim untested, and what is untested has no evidence.
    folded = tested.withColumn("status", F.col("v.status")).withColumn("evidence", F.when(F.col("v.status") == "untested", F.lit("")).otherwise(F.col("v.why")))
    return claims.filter(~own).unionByName(folded.select(claims.columns))


@dataclass
class BeliefGraph:
    """The three tables, validated on construction."""

    nodes: DataFrame
    claims: DataFrame
    rests_on: DataFrame
    driver_edges: int = DRIVER_EDGES

    def __post_init__(self) -> None:
        self.nodes, self.claims, self.rests_on = (compact(t, self.driver_edges) for t in (self.nodes, self.claims, self.rests_on))
        if first := violations(self.nodes, self.claims, self.rests_on).first():
            raise BeliefError(f"claim {first.idx}: {first.message}" if first.idx >= 0 else first.message)

    def _known(self, node: str) -> None:
        if self.nodes.filter(F.col("id") == node).isEmpty():
            raise BeliefError(f"no node is called {node!r}")

    def knows(self, name: str) -> bool:
        """Whether it is an artefact that rests on something."""
        return not self.rests_on.filter(F.col("artefact") == name).isEmpty()

    def stale_if(self, node: str) -> list[str]:
        self._known(node)
        seeds = small_table(self.nodes.sparkSession, [(node,)], "src string")
        return [r.dst for r in closure(stale_edges(self.claims), seeds, self.driver_edges).orderBy("dst").collect()]

    def stale_table(self) -> DataFrame:
        """(changed, goes_stale) of all nodes."""
        return closure(stale_edges(self.claims), None, self.driver_edges).select(F.col("src").alias("changed"), F.col("dst").alias("goes_stale"))

    def in_doubt(self, node: str) -> list[str]:
        """What a node rests on, which doubt about it would come from."""
        self._known(node)
        start = small_table(self.nodes.sparkSession, [(node,)], "src string")
        return [r.dst for r in doubt_reach(self.claims, start, self.driver_edges).orderBy("dst").collect()]

    def doubt_table(self) -> DataFrame:
        return doubt_reach(self.claims, self.nodes.select(F.col("id").alias("src")), self.driver_edges).select(F.col("src").alias("node"), F.col("dst").alias("rests_on"))

    def supports_edges(self) -> DataFrame:
        """(supporter, supported): one hop of rests-on, peers left out."""
        return rest_edges(self.claims).select(F.col("dst").alias("supporter"), F.col("src").alias("supported")).orderBy("supporter", "supported")

    @cached_property
    def all_caveats(self) -> DataFrame:
        return caveats(self.claims, self.rests_on, self.driver_edges)

    def caveats_on(self, artefact: str) -> DataFrame:
        """None for a name that rests on nothing declared; ``knows`` tells that from a clean one."""
        return caveats(self.claims, self.rests_on.filter(F.col("artefact") == artefact), self.driver_edges)

    def open_questions(self) -> DataFrame:
        return open_questions(self.claims)

    def contradictions(self) -> DataFrame:
        return contradictions(self.claims)

    def summary(self) -> DataFrame:
        """One row of counts; a caveat that reaches three artefacts is one caveat and three deliveries."""
        at = described(self.claims)
        claims = at.agg(
            F.count(F.lit(1)).alias("claims"),
            F.count_if(F.col("tested_by").isNotNull()).alias("recomputed"),
            F.count_if("open_question").alias("open_questions"),
            F.count_if("carries_caveat").alias("carrying"),
        )
        given = self.all_caveats.agg(F.count_distinct("claim").alias("caveats"), F.count(F.lit(1)).alias("caveat_deliveries"))
        rest = {"nodes": self.nodes, "stale_pairs": self.stale_table(), "contradictory_triples": self.contradictions()}
        counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in rest.items()]
        counts.append(self.rests_on.agg(F.count_distinct("artefact").alias("artefacts")))
        # One row of counts each: they are put under each other and then side by side.
        named = [df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns]))) for df in (claims, given, *counts)]
        names = [c for df in (claims, given, *counts) for c in df.columns]
        one = reduce(DataFrame.union, named).agg(*[F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in names])
        return one.withColumn("caveats_undeliverable", F.when(F.col("artefacts") == 0, F.col("carrying")).otherwise(F.lit(0).cast("long"))).drop("carrying")

    def by_status(self) -> DataFrame:
        return self.claims.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def report(self) -> dict:
        """What is published; a graph's report lists its claims, so it is as large as they are."""
        found: dict[str, list] = {}
        for r in self.all_caveats.collect():
            found.setdefault(r.artefact, []).append({k: v for k, v in r.asDict().items() if k not in ("artefact", "idx")})
        rests = self.rests_on.distinct().collect()
        names = sorted({r.artefact for r in rests})
        return {
            "summary": self.summary().first().asDict() | {"by_status": {r.status: r.n for r in self.by_status().orderBy("status").collect()}},
            "nodes": [r.asDict() for r in self.nodes.orderBy("id").collect()],
            "claims": [r.asDict() for r in self.claims.orderBy("idx").collect()],
            "rests_on": {n: sorted(r.node for r in rests if r.artefact == n) for n in names},
            "caveats": {n: found.get(n, []) for n in names},
            "open_questions": [r.asDict() for r in self.open_questions().collect()],
            "contradictions": [r.asDict() for r in self.contradictions().collect()],
        }


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return small_table(spark, [], NODES), small_table(spark, [], CLAIMS), small_table(spark, [], RESTS_ON)
