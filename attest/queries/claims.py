"""Estimators, intervals, joins and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, DatasetSpec, Relationship, Variable
from ..operators import bootstrap, pairs
from ..operators.estimators import ESTIMATORS, average_ranks, pearson, point_spearman
from ..operators.joins import checked_join, coverage, key_counts
from ..operators.verdicts import tallies
from ..plans.check import check_loaded
from ..sources.tables import ROW, Dataset
from . import register, table

#: Replicates of the queries below.
B = 200


def _r(x: str, y: str) -> str:
    """Pearson's r in SQL: null under three rows and for a constant side."""
    return f"case when count({x}) >= 3 and min({x}) < max({x}) and min({y}) < max({y}) then round(covar_pop({y}, {x}) / sqrt(var_pop({x}) * var_pop({y})), 6) end"


@register(f"select l_returnflag, count(*) as n, {_r('l_quantity', 'l_extendedprice')} as r from lineitem group by l_returnflag")
def corr_pearson_by_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(pearson(x, y), 6).alias("r"))


@register(
    """with r as (select p_brand as claim,
  rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0 as x,
  rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0 as y from part)
select claim, """
    + _r("x", "y")
    + " as estimate from r group by claim"
)
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "part").select(F.col("p_brand").alias("claim"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return point_spearman(long).select("claim", F.round("estimate", 6).alias("estimate"))


@register("select o_orderstatus, o_orderkey, rank() over (partition by o_orderstatus order by o_custkey) + (count(*) over (partition by o_orderstatus, o_custkey) - 1) / 2.0 as rank from orders")
def tied_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_ranks(table(spark, sf_dir, "orders"), "o_custkey", "rank", "o_orderstatus").select("o_orderstatus", "o_orderkey", "rank")


def _supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("claim"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        F.col("l_suppkey").cast("string").alias("unit"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
    )


_MOMENTS = """m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem),
u as (select cast(l_suppkey as varchar) as unit, count(*)::double as n, sum(l_quantity - mx) as sx, sum(l_extendedprice - my) as sy,
  sum((l_quantity - mx) * (l_quantity - mx)) as sxx, sum((l_extendedprice - my) * (l_extendedprice - my)) as syy,
  sum((l_quantity - mx) * (l_extendedprice - my)) as sxy from lineitem, m group by l_suppkey)"""

_INTERVAL = f"""draws as (select rep, ('0x' || substr(md5('20260815:' || rep || ':' || k), 1, 12))::bigint % g as u
  from range(0, {B}) a(rep), (select count(*) as g from u) c, lateral (select unnest(range(0, g)) as k)),
numbered as (select *, row_number() over (order by unit) - 1 as u from u),
reps as (select rep, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy from draws join numbered using (u) group by rep),
ordered as (select (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) as r, row_number() over (order by (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))) - 1 as i from reps),
ci as (select max(r) filter (where i = {int(0.025 * B)}) as ci_lo, max(r) filter (where i = {min(int(0.975 * B), B - 1)}) as ci_hi from ordered)"""


@register(f"with {_MOMENTS} select unit, n, round(sxx, 3) as sxx, round(syy / 1e6, 3) as syy_m, round(sxy, 1) as sxy from u")
def cluster_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bootstrap.moments(_supplier_pairs(spark, sf_dir))
    return m.select("unit", "n", F.round("sxx", 3).alias("sxx"), F.round(F.col("syy") / 1e6, 3).alias("syy_m"), F.round("sxy", 1).alias("sxy"))


@register(f"with {_MOMENTS}, {_INTERVAL} select round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi, (select count(*) from u) as n_units from ci")
def bootstrap_ci_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps, info = bootstrap.replicates_of(_supplier_pairs(spark, sf_dir), ESTIMATORS["pearson"], "hash", B)
    return bootstrap.intervals(reps, info, B).select(F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"), "n_units")


#: A replicate's numbers of rows, each its own unit, and Pearson's r by weighted sums.
_ROW_INTERVAL = f"""v as (select rep, l_quantity as x, l_extendedprice as y, (('0x' || substr(d, 1, 8))::bigint % {bootstrap.PRIME} + ('0x' || substr(d, 9, 8))::bigint % {bootstrap.PRIME} * rep) % {bootstrap.PRIME} as v
  from (select *, md5('{bootstrap.SEED}:' || (l_orderkey * 10 + l_linenumber)) as d from lineitem), range(0, 20) a(rep)),
w as (select rep, x - (select avg(l_quantity) from lineitem) as x, y - (select avg(l_extendedprice) from lineitem) as y, {" + ".join(f"(v >= {t})::int" for t in bootstrap.poisson_steps())} as w from v),
reps as (select rep, sum(w) as n, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * y * y) as syy, sum(w * x * y) as sxy from w where w > 0 group by rep),
ordered as (select (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) as r, row_number() over (order by (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))) - 1 as i from reps)"""


@register(f"with {_ROW_INTERVAL} select round(max(r) filter (where i = 0), 6) as ci_lo, round(max(r) filter (where i = 19), 6) as ci_hi, (select count(*) from lineitem) as n_units, 'poisson' as mode from ordered")
def bootstrap_ci_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as units: Poisson weights made beside the data, so nothing but replicates' sums is shuffled."""
    rows = _supplier_pairs(spark, sf_dir).withColumn("unit", F.lit(None).cast("string"))
    reps, info = bootstrap.replicates_of(rows, ESTIMATORS["pearson"], "poisson", 20)
    return bootstrap.intervals(reps, info, 20).select(F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"), "n_units", "mode")


#: Ranks of weighted values: those below, and the middle of the value's own.
_RANK_INTERVAL = f"""g as (select count(distinct p_brand) as g from part),
numbered as (select p_brand, row_number() over (order by p_brand) - 1 as u from (select distinct p_brand from part)),
draws as (select rep, ('0x' || substr(md5('{bootstrap.SEED}:' || rep || ':' || k), 1, 12))::bigint % g as u from range(0, {B}) a(rep), g, lateral (select unnest(range(0, g)) as k)),
rows as (select rep, p_size as x, p_retailprice as y, w from part join numbered using (p_brand) join (select rep, u, count(*) as w from draws group by rep, u) using (u)),
rx as (select rep, x, sum(sum(w)) over (partition by rep order by x) - sum(w) + (sum(w) + 1) / 2.0 as a from rows group by rep, x),
ry as (select rep, y, sum(sum(w)) over (partition by rep order by y) - sum(w) + (sum(w) + 1) / 2.0 as b from rows group by rep, y),
ranks as (select rep, w, a::double - avg(a) over (partition by rep) as a, b::double - avg(b) over (partition by rep) as b from rows join rx using (rep, x) join ry using (rep, y)),
sums as (select rep, sum(w) as n, sum(w * a) as sx, sum(w * b) as sy, sum(w * a * a) as sxx, sum(w * b * b) as syy, sum(w * a * b) as sxy from ranks group by rep),
ordered as (select r, row_number() over (order by r) - 1 as i from (select (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) as r from sums))"""


@register(f"with {_RANK_INTERVAL} select round(max(r) filter (where i = {int(0.025 * B)}), 6) as ci_lo, round(max(r) filter (where i = {min(int(0.975 * B), B - 1)}), 6) as ci_hi, (select g from g) as n_units from ordered")
def bootstrap_ci_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are taken anew in each replicate; the pairs, below a checked number, are on every executor."""
    long = table(spark, sf_dir, "part").select(F.lit(0).alias("claim"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_brand").alias("unit"), F.col("p_partkey").alias("row"))
    reps, info = bootstrap.replicates_of(long, ESTIMATORS["spearman"], "hash", B)
    return bootstrap.intervals(reps, info, B).select(F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"), "n_units")


@register(f"select event_type, {_r('one', 'value')} as r from (select *, 1.0::double as one from events) group by event_type")
def undefined_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(pearson(F.lit(1.0), F.col("value")), 6).alias("r"))


#: Claims of the headline query, which are all over one table or stop before any job.
_FEW = ("no_link", "strong_link", "no_unit", "no_method", "no_join", "no_column")


def _claims(spark: SparkSession, sf_dir: str, every: bool = False):
    """Some claims, or one for each reason that the check can give."""

    def dataset(name: str, rows: DataFrame, unit: str | None = None) -> Dataset:
        return Dataset(DatasetSpec(name, "computed", (f"{name}.parquet",), resampling_unit=unit), rows.withColumn(ROW, F.monotonically_increasing_id()), {})

    lines, k = table(spark, sf_dir, "lineitem"), F.col("s_suppkey")
    # y is x to a millionth or so: not one by rounding alone, and near enough to a claimed one.
    exact = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(" ").alias("nothing"), F.lit(1.0).alias("one"), (k % 10).cast("double").alias("x"), (k % 10 + 3.6e-6 * ((k * 7) % 11 - 5) / 5.0).alias("y"))
    # Only replicates with both regions have two sides that vary.
    regions = table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_regionkey") == 0).cast("double").alias("first"), (F.col("n_regionkey") == 1).cast("double").alias("second"))
    made = (
        dataset("lineitem", lines.select("l_suppkey", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"), "l_suppkey"),
        dataset("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")),
        dataset("lines", lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_tax")),
        dataset("exact", exact),
        dataset("regions", regions, "n_regionkey"),
    )
    datasets = {d.spec.id: d for d in made}
    known = [("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("lines", "l_tax"), ("exact", "one"), ("exact", "x"), ("exact", "y"), ("regions", "first"), ("regions", "second")]
    variables = {v: Variable(*v, "1") for v in known} | {("lineitem", "l_discount"): Variable("lineitem", "l_discount")}

    def says(name: str, x: str, y: str, claimed: float, method: str = "pearson", kind: str = "correlation", **more) -> Relationship:
        return Relationship(x, y, kind, method, claimed, name, **more)

    quantity, price = "lineitem.l_quantity", "lineitem.l_extendedprice"
    relationships = (
        says("no_link", quantity, price, 0.0),
        says("strong_link", quantity, price, 0.9),
        says("no_unit", quantity, "lineitem.l_discount", 0.0),
        says("no_method", quantity, price, 0.0, "kendall"),
        says("no_join", quantity, "orders.o_totalprice", 0.0),
        says("no_column", quantity, "lineitem.l_weight", 0.0),
        says("another_kind", quantity, price, 0.0, kind="slope"),
        says("no_dataset", quantity, "nowhere.v", 0.0),
        says("many_lines", "lines.l_tax", "orders.o_totalprice", 0.0, join="o_orderkey"),
        says("no_unit_column", quantity, price, 0.0, resampling_unit="l_nothing"),
        says("blank_unit", "exact.x", "exact.y", 0.0, resampling_unit="nothing"),
        says("constant", "exact.one", "exact.y", 0.0),
        says("two_units", quantity, price, 0.0, resampling_unit="l_linestatus"),
        says("mostly_constant", "regions.first", "regions.second", 0.0),
        says("nearly_one", "exact.x", "exact.y", 1.0, resampling_unit="s_suppkey"),
        says("too_wide", quantity, price, 0.0, max_ci_width=1e-6),
    )
    if not every:
        relationships = tuple(r for r in relationships if r.id in _FEW)
        datasets = {k: datasets[k] for k in ("lineitem", "orders")}
    catalog = Catalog("", {"name": "tables"}, {k: d.spec for k, d in datasets.items()}, variables, relationships)
    return check_loaded(spark, catalog, datasets, "hash", B)


_VERDICTS = f"""exact as (select s_suppkey, (s_suppkey % 10)::double as x, s_suppkey % 10 + 3.6e-6::double * ((s_suppkey * 7) % 11 - 5) / 5.0::double as y from supplier),
asked(id, source, claimed, most, stop) as (values ('no_link', 'lines', 0.0, 1.0, null), ('strong_link', 'lines', 0.9, 1.0, null), ('no_unit', null, 0.0, 1.0, 'units'), ('no_method', null, 0.0, 1.0, 'method'),
  ('no_join', null, 0.0, 1.0, 'no_join'), ('no_column', null, 0.0, 1.0, 'columns'), ('another_kind', null, 0.0, 1.0, 'kind'), ('no_dataset', null, 0.0, 1.0, 'dataset'), ('many_lines', null, 0.0, 1.0, 'join_refused'),
  ('no_unit_column', null, 0.0, 1.0, 'no_unit_column'), ('blank_unit', 'blank', 0.0, 1.0, null), ('constant', 'constant', 0.0, 1.0, null), ('two_units', 'status', 0.0, 1.0, null), ('mostly_constant', 'regions', 0.0, 1.0, null),
  ('nearly_one', 'exact', 1.0, 1.0, null), ('too_wide', 'lines', 0.0, 1e-6, null)),
pairs as (select 'lines' as source, l_quantity as x, l_extendedprice as y, l_suppkey::varchar as unit from lineitem union all select 'status', l_quantity, l_extendedprice, l_linestatus from lineitem
  union all select 'blank', x, y, ' ' from exact union all select 'constant', 1.0::double, y, s_suppkey::varchar from exact union all select 'exact', x, y, s_suppkey::varchar from exact
  union all select 'regions', (n_regionkey = 0)::int::double, (n_regionkey = 1)::int::double, n_regionkey::varchar from nation),
points as (select source, count(*) as n_rows, avg(x) as mx, avg(y) as my, count(distinct unit) as g, bool_and(trim(unit) = '') as blank, {_r("x", "y")} as estimate from pairs group by source),
units as (select source, unit, count(*)::double as n, sum(x - mx) as sx, sum(y - my) as sy, sum((x - mx) * (x - mx)) as sxx, sum((y - my) * (y - my)) as syy, sum((x - mx) * (y - my)) as sxy,
  min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from pairs join points using (source) group by source, unit),
drawn as (select source, rep, ('0x' || substr(md5('{bootstrap.SEED}:' || rep || ':' || k), 1, 12))::bigint % g as u from points, range(0, {B}) a(rep), lateral (select unnest(range(0, g)) as k)),
weighed as (select * from drawn join (select *, row_number() over (partition by source order by unit) - 1 as u from units) using (source, u)),
summed as (select source, rep, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy, min(lx) < max(hx) and min(ly) < max(hy) as varies from weighed group by source, rep),
replicated as (select source, (n * sxy - sx * sy) / nullif(sqrt(greatest(n * sxx - sx * sx, 0) * greatest(n * syy - sy * sy, 0)), 0) as r from summed where n >= 3 and varies),
ranked as (select *, row_number() over (partition by source order by r) - 1 as i, count(*) over (partition by source) as m from replicated where r is not null),
spread as (select source, max(r) filter (where i = floor(0.025 * m)) as ci_lo, max(r) filter (where i = least(floor(0.975 * m), m - 1)) as ci_hi from ranked where m >= {B // 2} group by source),
measured as (select id, claimed::double as claimed, most, stop, n_rows, estimate, case when g >= 3 then ci_lo end as ci_lo, case when g >= 3 then ci_hi end as ci_hi, g as n_units, blank from asked left join points using (source) left join spread using (source)),
judged as (select id, claimed, n_rows, estimate, round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi, n_units, case when stop is not null then stop when blank then 'blank_unit' when estimate is null then 'undefined'
  when ci_lo is null and n_units < 3 then 'few_units' when ci_lo is null then 'few_replicates' when claimed between ci_lo and ci_hi then case when ci_hi - ci_lo > most then 'wide' else 'inside' end
  when abs(claimed) = 1 and abs(claimed - estimate) <= 1e-6 then 'known_answer' else 'outside' end as reason_code from measured),
verdicts as (select *, case when reason_code = 'outside' then 'refuted' when reason_code in ('inside', 'known_answer') then 'agrees' else 'unverifiable' end as verdict from judged)"""


_JUDGED = ("id", "claimed", "n_rows", "estimate", "ci_lo", "ci_hi", "n_units", "reason_code", "verdict", "status")
_STATUS = "case verdict when 'refuted' then 'falsified' when 'agrees' then 'measured' else 'untested' end as status"


@register(f"with {_VERDICTS} select *, {_STATUS} from verdicts where id in {_FEW}")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).verdicts.select(*_JUDGED)


@register(f"with {_VERDICTS} select *, {_STATUS} from verdicts")
def claim_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that end with each reason code that there is."""
    return _claims(spark, sf_dir, every=True).verdicts.select(*_JUDGED)


@register(f"with {_VERDICTS} select verdict, count(*) as n from verdicts where id in {_FEW} group by verdict")
def verdict_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(_claims(spark, sf_dir).verdicts)


@register(
    r"""with s as (select item_id, text, length(text) % 7 / 10.0::double - 0.3 as claimed, length(text) % 11 / 12.5::double - 0.4 as estimate, length(text) % 3 > 0 as has_interval, item_id % 5 as few from benchmark)
select 'item ' || item_id as id, rtrim('item ' || item_id || chr(10) || 'a.x and b.y' || chr(10) || regexp_replace('claimed ' || printf('%+.2f', claimed) || '; ' || case when few = 0 then 'not measured' else 'found pearson ' || printf('%+.3f', estimate)
  || case when estimate <> claimed and abs(estimate - claimed) < 0.0005 then printf(' (%+.2e from the claim)', estimate - claimed) else '' end || ', ' || case when has_interval then '95% interval ' || printf('%+.3f', estimate - 0.1) || ' to ' || printf('%+.3f', estimate + 0.1) else 'no interval' end
  || ', ' || length(text) || ' x row, R2 ' || printf('%.3f', estimate * estimate) end, '(.{1,110})(\s+|$)', '\1' || chr(10), 'g') || 'AGREES: it was said so' || chr(10) || length(text) || ' rows' || case when few > 1 then ', ' || few || ' dropped' else '' end || '; a from a.csv; b', chr(10)) as caption from s"""
)
def claim_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.figures import captions

    n, few = F.char_length("text"), F.col("item_id") % 5
    rows = table(spark, sf_dir, "benchmark").withColumns({"claimed": n % 7 / 10.0 - 0.3, "estimate": F.when(few > 0, n % 11 / 12.5 - 0.4)})
    interval = F.when(n % 3 > 0, F.col("estimate"))
    told = rows.select(
        F.concat(F.lit("item "), "item_id").alias("id"), F.lit("a.x").alias("x"), F.lit("b.y").alias("y"), F.lit("b").alias("x_dataset"), F.lit("a").alias("y_dataset"), F.lit("pearson").alias("method"),
        F.lit(None).cast("map<string,string>").alias("evidence"), "claimed", "estimate", (interval - 0.1).alias("ci_lo"), (interval + 0.1).alias("ci_hi"), F.lit(0.95).alias("ci_level"), n.alias("n_units"),
        F.lit(None).cast("string").alias("resampling_unit"), n.alias("n_rows"), F.when(few > 1, few).alias("dropped"), F.lit("agrees").alias("verdict"), F.lit("it was said so").alias("why"),
    )
    return captions(told, {"a": ("a.csv",)})


def _coverage(left: str, l_key: str, right: str, r_key: str) -> str:
    return f"""with k as (select key, sum(l) as l, sum(r) as r from (select {l_key} as key, 1 as l, 0 as r from {left} union all select {r_key}, 0, 1 from {right}) group by key)
select cast(sum(l) as bigint) as n_left, cast(sum(r) as bigint) as n_right, count(*) filter (where l > 0 and r > 0) as n_matched, cast(sum(l) - count(*) filter (where l > 0 and r > 0) as bigint) as n_left_unmatched,
  cast(sum(r) - count(*) filter (where l > 0 and r > 0) as bigint) as n_right_unmatched, round(count(*) filter (where l > 0 and r > 0) / greatest(sum(l), 1)::double, 4) as coverage,
  count(*) filter (where l > 1) as n_duplicate_keys_left, count(*) filter (where r > 1) as n_duplicate_keys_right from k"""


@register(_coverage("documents", "doc_id", "labels", "doc_id"))
def join_coverage_documents_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").drop("example_left", "example_right")


@register(_coverage("orders", "o_orderkey", "lineitem", "l_orderkey"))
def join_refused_orders_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return coverage(table(spark, sf_dir, "orders"), right, "o_orderkey").drop("example_left", "example_right")


@register("select d.doc_id, lang, quality, toxic from documents d join labels l on d.doc_id = l.doc_id")
def checked_join_documents_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined, report = checked_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", ("documents", "labels"))
    if joined is None:
        raise ValueError(report.refused)
    return joined.select("l.doc_id", "l.lang", "r.quality", "r.toxic")


@register("select cast(l_orderkey as varchar) as key, count(*) as n from lineitem group by l_orderkey having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return key_counts(lines, lines.limit(0), "l_orderkey").filter("l > 1").select("key", F.col("l").alias("n"))


@register(
    """with p as (select try_cast(json_extract_string(props, '$.k') as double) as x, case when isfinite(value) then value end as y, user_id from events)
select user_id, count(*) filter (where x is not null and y is not null) as n_rows, count(*) filter (where x is null or y is null) as dropped,
  round(avg(x) filter (where x is not null and y is not null), 6) as mean_x, round(avg(y) filter (where x is not null and y is not null), 6) as mean_y from p group by user_id"""
)
def paired_finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.parse import finite, number

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), number(F.get_json_object("props", "$.k")).alias("x"), finite(F.col("value")).alias("y"), F.col("event_type").alias("unit"))
    found = pairs.counted(events)
    return found.select(F.col("claim").alias("user_id"), "n_rows", "dropped", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"))


@register("with a as (select o_orderkey, o_orderdate, o_totalprice from orders where o_orderstatus = 'F'), b as (select o_orderkey, o_totalprice from orders where o_orderstatus <> 'F') select * from a union all by name select * from b")
def appended_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one dataset, appended by column name; columns that a later one lacks are null there."""
    orders = table(spark, sf_dir, "orders")
    first = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_totalprice")
    return first.unionByName(orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice"), allowMissingColumns=True)
