"""Scalar functions over tables: parsing, units, label rules, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text, units
from ..functions.parse import NUMBER, number
from . import register, table

_CELLS = [" 1 ", "1_000", "1__0", "1.5d", "1.5f", "1,5", "0x10", "1e5", "-.5", "5.", "+7", "nan", "inf", "", "  ", "1e", "1_0.2_5e1_0", "abc"]
_VALUES = ", ".join(f"('{c}')" for c in _CELLS)


@register(f"""with cells(cell) as (values {_VALUES}) select s_suppkey, cell, case when regexp_matches(trim(cell), '{NUMBER.replace("'", "''")}') then try_cast(replace(trim(cell), '_', '') as double) end as value from supplier, cells""")
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.lit(c) for c in _CELLS])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(cells).alias("cell")).withColumn("value", number(F.col("cell")))


_UNITS = ", ".join(f"('{u}', '{q}')" for u, q in units.UNITS.items())
_FACTORS = ", ".join(f"('{s}', '{t}', {f!r}::double)" for (s, t), f in units.FACTORS.items())
_SQL_UNITS = f"u(symbol, quantity) as (values {_UNITS}), f(source, target, factor) as (values {_FACTORS})"


@register(f"with {_SQL_UNITS} select p_partkey, f.source, f.target, round(p_retailprice * factor, 6) as converted from part join (select *, row_number() over (order by source, target) - 1 as k from f) f on p_partkey % {len(units.FACTORS)} = k")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sorted(units.FACTORS)
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), (F.col("p_partkey") % len(pairs) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", pick(0).alias("source"), pick(1).alias("target"))
    return units.converted(rows, "p_retailprice", "source", "target").select("p_partkey", "source", "target", F.round("converted", 6).alias("converted"))


@register(
    f"""with {_SQL_UNITS}, s as (select symbol from u union all values ('furlong'), (null)), p as (select a.symbol as x, b.symbol as y from s a, s b)
select x, y, case when x is null or y is null or qx is null or qy is null then false when x = y then true when qx <> qy then true else linked end as ok from (
  select p.*, ux.quantity as qx, uy.quantity as qy, exists (select 1 from f where source = x and target = y) as linked from p left join u ux on ux.symbol = x left join u uy on uy.symbol = y)"""
)
def unit_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = [(u,) for u in units.UNITS] + [("furlong",), (None,)]
    one = spark.createDataFrame(symbols, "x string")
    pairs = one.select("x", F.explode(F.array(*[F.lit(s) for (s,) in symbols])).alias("y"))
    return pairs.select("x", "y", units.compatible(F.col("x"), F.col("y"))["ok"].alias("ok"))


@register(f"with {_SQL_UNITS} select symbol, quantity from u")
def unit_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.units_table(spark)


RULE = labels.LabelRule("quality", "reading", "kept", "quality = 1")


@register("select lang, cast(sum(quality) as bigint) as n_positive, count(quality) as n_total, round(sum(quality) / count(quality)::double, 6) as rate, 'quality' as rule, 'reading' as assay, 'kept' as endpoint from documents join labels using (doc_id) group by lang")
def label_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return labels.rates(rows, "lang", "quality", RULE).select("lang", "n_positive", "n_total", F.round("rate", 6).alias("rate"), F.col("rule.name").alias("rule"), "rule.assay", "rule.endpoint")


_RULES = "r as (select n_nationkey as k, 'assay' || (n_nationkey % 3) as assay, 'end' || (n_nationkey % 2) as endpoint from nation)"


@register(f"with {_RULES} select a.k as a, b.k as b, a.assay = b.assay and a.endpoint = b.endpoint as ok, case when a.assay <> b.assay then 'assays differ: ' || a.assay || ' / ' || b.assay when a.endpoint <> b.endpoint then 'endpoints differ: ' || a.endpoint || ' / ' || b.endpoint else 'same assay and endpoint' end as why from r a join r b on a.k % 5 = b.k % 5")
def label_rules_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    one = table(spark, sf_dir, "nation").select(n.alias("k"), F.concat(F.lit("assay"), n % 3).alias("assay"), F.concat(F.lit("end"), n % 2).alias("endpoint"), (n % 5).alias("g"))
    a, b = one.alias("a"), one.alias("b")
    judged = labels.comparable(F.col("a.assay"), F.col("a.endpoint"), F.col("b.assay"), F.col("b.endpoint"))
    return a.join(b, F.col("a.g") == F.col("b.g")).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), judged.alias("j")).select("a", "b", "j.ok", "j.why")


@register(r"select p_partkey, regexp_replace(p_name, '[^\p{L}\p{N}]', '_', 'g') as plain, regexp_replace(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as folded from part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("plain"), text.slug(F.col("p_type"), "-", True).alias("folded"))


_ENDS = [".csv", ".JSON", ".ttl", ".png", ".zip", ""]
_SQL_MEDIA = " ".join(f"when '{k}' then '{v}'" for k, v in text.MEDIA_TYPES.items())


@register(f"""with e as (select s_suppkey, 'data.v1/file' || s_suppkey || [{", ".join(f"'{x}'" for x in _ENDS)}][s_suppkey % {len(_ENDS)} + 1] as path from supplier) select path, case lower(regexp_extract(path, '(\\.[^./]+)$', 1)) {_SQL_MEDIA} else 'application/octet-stream' end as media_type from e""")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (F.col("s_suppkey") % len(_ENDS) + 1).cast("int"))
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.lit("data.v1/file"), F.col("s_suppkey").cast("string"), end).alias("path"))
    return paths.select("path", text.media_type(F.col("path")).alias("media_type"))


@register("with t as (select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') else strftime(o_orderdate, '%d.%m.%Y') end as said from orders) select o_orderkey, said, length(said) >= 10 and substr(said, 5, 1) = '-' and substr(said, 8, 1) = '-' as is_time, case when contains(said, 'T') then said else said || 'T00:00:00' end as stamp from t")
def timestamps_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    said = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "dd.MM.yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return rows.select("o_orderkey", "said", text.is_timestamp(F.col("said")).alias("is_time"), text.as_datetime(F.col("said")).alias("stamp"))


@register("select c_custkey, case when c_custkey % 2 = 0 then 'https://orcid.org/' || lpad(c_custkey::varchar, 8, '0') else 'http://people/' || c_custkey end as iri from customer")
def creator_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case when c_custkey % 2 = 0 then lpad(cast(c_custkey as string), 8, '0') else concat('http://people/', c_custkey) end")
    return table(spark, sf_dir, "customer").select("c_custkey", text.orcid(said).alias("iri"))


_RIGHTS = sorted(text.ACCESS_RIGHTS)


@register("select c_custkey, case c_custkey % {n} {cases} end as iri from customer".format(n=len(_RIGHTS), cases=" ".join(f"when {i} then '{text.ACCESS_RIGHTS[r]}'" for i, r in enumerate(_RIGHTS))))
def access_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(f" {r.upper()} ") for r in _RIGHTS]), (F.col("c_custkey") % len(_RIGHTS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.access_right(said).alias("iri"))


@register("select item_id, array_to_string(string_split_regex(replace(replace(text, '. ', '.' || chr(1)), '; ', ';' || chr(1)), chr(1))[1:2], ' ') as lead from (select item_id, regexp_replace(regexp_replace(text, '[\\s]+', ' ', 'g'), '([.:;]) ([^A-Z(])', '\\1_\\2', 'g') as text from benchmark)")
def lead_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"([.:;]) ([^A-Z(])", "$1_$2")
    return table(spark, sf_dir, "benchmark").select("item_id", text.sentences(plain, 2).alias("lead"))


@register("select s_suppkey, printf('%+.3f', s_acctbal) as signed, case when abs(s_acctbal - round(s_acctbal, 0)) > 0 and abs(s_acctbal - round(s_acctbal, 0)) < 0.05 then true else false end as near from supplier")
def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.col("s_acctbal") - F.round("s_acctbal", 0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("%+.3f", F.col("s_acctbal")).alias("signed"), ((off > 0) & (off < 0.05)).alias("near"))
