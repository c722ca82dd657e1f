"""Statements as a table: evidence down to digests, challenges along support, lines for a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.triples import challenged, evidence_paths, link, made, ntriples, say
from . import register, table


def _name(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are files, suppliers are columns in them; a customer's evidence supports a claim about two suppliers."""
    suppliers = table(spark, sf_dir, "supplier")
    n = spark.createDataFrame([(suppliers.count(),)], "n long")
    files = made(table(spark, sf_dir, "nation"), [say(_name("file", "n_nationkey"), "sc:sha256", F.sha2(F.col("n_name"), 256))])
    fields = made(suppliers, [link(_name("field", "s_suppkey"), "at:inFile", _name("file", "s_nationkey"))])
    asked = table(spark, sf_dir, "customer").join(F.broadcast(n)).withColumns({"a": F.col("c_custkey") % F.col("n") + 1, "b": F.col("c_custkey") * 7 % F.col("n") + 1})
    claims = made(
        asked,
        [
            link(_name("evidence", "c_custkey"), "evi:directlySupports", _name("claim", "c_custkey")),
            say(_name("evidence", "c_custkey"), "sc:identifier", F.col("c_name")),
            link(_name("claim", "c_custkey"), "at:x", _name("field", "a")),
            link(_name("claim", "c_custkey"), "at:y", _name("field", "b")),
        ],
    )
    return files.union(fields).union(claims)


@register(
    """with n as (select count(*) as n from supplier), c as (select c_custkey, c_name, unnest([c_custkey % n + 1, c_custkey * 7 % n + 1]) as k from customer, n)
select distinct c_name as locator, 'field/' || s_suppkey as field, 'file/' || s_nationkey as file, sha256(n_name) as sha256 from c join supplier on s_suppkey = k join nation on n_nationkey = s_nationkey"""
)
def evidence_to_digest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_paths(statements(spark, sf_dir))


@register(
    """with recursive s(src, dst) as (select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'r' || r_regionkey, 'w' from region union select 'w', 'r0'),
d(challenger, src) as (select 'v' || s_suppkey, 's' || s_suppkey from supplier where s_suppkey % 5 = 0),
c(challenger, src, target) as (select challenger, d.src, dst from d join s on s.src = d.src union select c.challenger, c.src, s.dst from c join s on s.src = c.target)
select distinct challenger, target from c where target <> src"""
)
def challenge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    at = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    loop = spark.range(1).select(F.lit("w").alias("w"))
    t = (
        made(n, [link(at("n", "n_nationkey"), "evi:supports", at("r", "n_regionkey"))])
        .union(made(s, [link(at("s", "s_suppkey"), "evi:supports", at("n", "s_nationkey")), (F.col("s_suppkey") % 5 == 0, link(at("v", "s_suppkey"), "evi:directlyChallenges", at("s", "s_suppkey")))]))
        .union(made(r, [link(at("r", "r_regionkey"), "evi:supports", F.lit("w"))]))
        .union(made(loop, [link(F.col("w"), "evi:supports", F.lit("r0"))]))
    )
    return challenged(t)


@register("""select '<part/' || p_partkey || '> <https://schema.org/name> "' || replace(replace(p_name || chr(10) || '"q"\\', '\\', '\\\\'), '"', '\\"').replace(chr(10), '\\n') || '" .' as value from part""")
def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return ntriples(made(part, [say(_name("part", "p_partkey"), "sc:name", F.concat(F.col("p_name"), F.lit('\n"q"\\')))]))
