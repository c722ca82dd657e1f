"""A rate of positives travels with the rule that decided what is positive."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LabelError


@dataclass(frozen=True)
class LabelRule:
    name: str
    assay: str
    endpoint: str
    positive_when: str
    threshold: str = ""
    source: str = ""
    note: str = ""

    def __post_init__(self) -> None:
        for f in fields(self)[:4]:
            if not str(getattr(self, f.name)).strip():
                raise LabelError(f"a label rule needs {f.name}")

    def describe(self) -> str:
        return f"{self.name} ({self.assay}, {self.endpoint})"

    def as_struct(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in asdict(self).items()])


def comparable(assay_a: Column, endpoint_a: Column, assay_b: Column, endpoint_b: Column) -> Column:
    """struct(ok, why): two rules compare only within one assay and one endpoint, in that order of objection."""

    def says(ok: bool, why: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), why.alias("why"))

    return (
        F.when(assay_a != assay_b, says(False, F.concat(F.lit("assays differ: "), assay_a, F.lit(" / "), assay_b)))
        .when(endpoint_a != endpoint_b, says(False, F.concat(F.lit("endpoints differ: "), endpoint_a, F.lit(" / "), endpoint_b)))
        .otherwise(says(True, F.lit("same assay and endpoint")))
    )


def rate(n_positive: int, n_total: int, rule: LabelRule) -> dict:
    if n_total <= 0:
        raise LabelError("a rate needs a positive total")
    if not 0 <= n_positive <= n_total:
        raise LabelError(f"{n_positive} of {n_total} is no share")
    return {"rate": n_positive / n_total, "n_positive": n_positive, "n_total": n_total, "rule": asdict(rule)}


def rates(df: DataFrame, group: str, label: str, rule: LabelRule) -> DataFrame:
    """group, n_positive, n_total, rate and the rule, one shuffle of partial counts.

    Null labels count for nothing; a group with none but nulls stops the job, and so does a label other than 0 and 1.
    """
    value = F.col(label)
    odd = F.count_if(~value.isin(0, 1))
    got = df.groupBy(group).agg(F.sum(F.when(value == 1, 1).otherwise(0)).cast("long").alias("n_positive"), F.count(value).alias("n_total"), odd.alias("_odd"))
    share = F.when(F.col("_odd") > 0, F.raise_error(F.lit("a label is neither 0 nor 1")).cast("double")).when(
        F.col("n_total") == 0, F.raise_error(F.lit("a rate needs a positive total")).cast("double")
    )
    return got.withColumn("rate", share.otherwise(F.col("n_positive") / F.col("n_total"))).drop("_odd").withColumn("rule", rule.as_struct())
