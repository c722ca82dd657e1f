"""Units as two small tables; nothing converts unless a factor says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnitError
from ..session import small_table

#: symbol -> quantity
UNITS = {
    "1": "dimensionless",
    "g/mol": "molar mass",
    "Da": "molar mass",
    "kcal/mol": "molar energy",
    "kJ/mol": "molar energy",
    "eV": "energy",
    "log10(1/M)": "affinity",
    "nm": "length",
    "0.1 nm": "length",
    "ps": "time",
    "ns": "time",
}
FACTORS = {
    ("Da", "g/mol"): 1.0,
    ("g/mol", "Da"): 1.0,
    ("kcal/mol", "kJ/mol"): 4.184,
    ("kJ/mol", "kcal/mol"): 1 / 4.184,
    ("nm", "0.1 nm"): 10.0,
    ("0.1 nm", "nm"): 0.1,
    ("ps", "ns"): 0.001,
    ("ns", "ps"): 1000.0,
}


def factor(source: str, target: str) -> float:
    """What to multiply by; refuses whatever is not in the tables."""
    for unit in (source, target):
        if unit not in UNITS:
            raise UnitError(f"unit {unit!r} is not known")
    if source == target:
        return 1.0
    if UNITS[source] != UNITS[target]:
        raise UnitError(f"{source} measures {UNITS[source]}, {target} measures {UNITS[target]}")
    if (source, target) not in FACTORS:
        raise UnitError(f"no factor leads from {source} to {target}")
    return FACTORS[source, target]


def convert(value: Column, source: str, target: str) -> Column:
    return value * F.lit(factor(source, target))


def units_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, sorted(UNITS.items()), "symbol string, quantity string")


def factors_table(spark: SparkSession) -> DataFrame:
    rows = [(s, t, f) for (s, t), f in FACTORS.items()] + [(u, u, 1.0) for u in UNITS]
    return small_table(spark, sorted(rows), "source string, target string, factor double")


def converted(df: DataFrame, value: str, source: str, target: str, out: str = "converted") -> DataFrame:
    """Row-wise conversion by unit columns; a pair without a factor stops the job."""
    known = F.broadcast(factors_table(df.sparkSession)).withColumnsRenamed({"source": "_source", "target": "_target", "factor": "_factor"})
    joined = df.join(known, (F.col(source) == F.col("_source")) & (F.col(target) == F.col("_target")), "left")
    wrong = F.concat(F.lit("no factor leads from "), F.coalesce(F.col(source), F.lit("null")), F.lit(" to "), F.coalesce(F.col(target), F.lit("null")))
    ratio = F.coalesce("_factor", F.raise_error(wrong).cast("double"))
    return joined.withColumn(out, F.col(value) * ratio).drop("_source", "_target", "_factor")


def compatible(x: Column, y: Column) -> Column:
    """struct(ok, why) for two unit symbols; null means that none was declared."""

    def quantity(u: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv]), u)

    pair = F.concat_ws("|", x, y)
    linked = pair.isin(*[f"{s}|{t}" for s, t in FACTORS])

    def says(ok: bool, why: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), why.alias("why"))

    return (
        F.when(x.isNull(), says(False, F.lit("x has no declared unit")))
        .when(y.isNull(), says(False, F.lit("y has no declared unit")))
        .when(quantity(x).isNull(), says(False, F.concat(x, F.lit(" is not a known unit"))))
        .when(quantity(y).isNull(), says(False, F.concat(y, F.lit(" is not a known unit"))))
        .when(x == y, says(True, F.lit("same unit")))
        .when(quantity(x) != quantity(y), says(True, F.concat(F.lit("different quantities: "), quantity(x), F.lit(" and "), quantity(y))))
        .when(linked, says(True, F.concat(x, F.lit(" converts to "), y)))
        .otherwise(says(False, F.concat(F.lit("no factor between "), x, F.lit(" and "), y)))
    )
