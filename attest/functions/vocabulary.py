"""The closed words of claim graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

#: status: (evidence_required, open_question, carries_caveat)
STATUSES = {
    "measured": (True, False, False),
    "published": (True, False, False),
    "by_construction": (False, False, False),
    "assumed": (False, True, True),
    "contested": (True, True, True),
    "falsified": (True, False, True),
    "untested": (False, True, True),
}
STATUS_MEANINGS = {
    "measured": "somebody tested it, and it held",
    "published": "a source outside says so",
    "by_construction": "it was made that way",
    "assumed": "it is taken for granted, and nobody has tested it here",
    "contested": "sources disagree about it",
    "falsified": "somebody tested it, and it did not hold",
    "untested": "nobody has looked",
}
NODE_KINDS = ("method", "reference", "parameter", "condition", "quantity", "representation", "strategy")
#: Where a doubt about a claim lands.
DOUBT_KINDS = ("to_subject", "to_object", "both_ways", "nowhere")
#: predicate: (direction in which change makes stale, doubt kind, meaning)
PREDICATES = {
    "approximates": ("backward", "to_subject", "the subject stands in for the object, with some error"),
    "is_cheaper_surrogate_for": ("backward", "to_subject", "the subject costs less and is used where the object would be too dear"),
    "is_distilled_from": ("backward", "to_subject", "the subject was fitted to what the object puts out"),
    "depends_on": ("backward", "to_subject", "the subject is computed from the object"),
    "is_precondition_of": ("forward", "to_object", "without the subject the object does not hold"),
    "is_validated_against": ("backward", "to_subject", "the subject's error was measured by the object"),
    "rescues_ranking_errors_of": ("backward", "to_subject", "the subject puts right an order that the object gets wrong"),
    "preserves_ordering_of": ("backward", "to_subject", "both rank alike, whatever their scales"),
    "shares_approximation_with": (None, "both_ways", "both err by the same simplification"),
    "supersedes": (None, "nowhere", "the subject is used from now on"),
    "is_invalidated_by": (None, "nowhere", "the object shows that the subject fails"),
    "dominates_error_of": (None, "nowhere", "most of the object's error comes from the subject"),
    "displaces_ranking_more_than": (None, "nowhere", "leaving out the subject shifts ranks further than leaving out the object"),
}
VERDICT_STATUS = {"agrees": "measured", "refuted": "falsified", "unverifiable": "untested"}


def status_meaning(status: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in STATUS_MEANINGS.items() for v in kv])
    return F.try_element_at(known, status)


def statuses(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(k, *v) for k, v in STATUSES.items()], "status string, evidence_required boolean, open_question boolean, carries_caveat boolean")


def predicates(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(k, *v) for k, v in PREDICATES.items()], "predicate string, stale string, doubt string, meaning string")


def node_kinds(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(k,) for k in NODE_KINDS], "kind string")
