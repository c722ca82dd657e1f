"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.  Fitting uses the stage's own input.

Cases: a null text is rejected by language ID; other nulls are kept; a text that substring dedup empties stays as an
empty document; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import langid, packing, secrets, simhash, substring
from attest.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is rejected below this score.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that training saw."""
    docs = docs.select(*COLUMNS)
    found = langid.predicted(docs, langid.train(docs))
    return found.filter((F.col("_at.lang_pred") != langid.UND) & (F.col("_at.score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group of near copies."""
    return simhash.representatives(docs.select(*COLUMNS))


def duplicate_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occur more than once from every text."""
    return _measured(docs, substring.cleaned(docs.select(*COLUMNS)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of each secret in its place."""
    docs = docs.select(*COLUMNS)
    found = docs.withColumn("_at", secrets.scanned(F.col("text"), secrets.train(docs)))
    return _measured(docs, found.withColumn("text", F.col("_at.redacted")).select(*COLUMNS))


def _measured(docs: DataFrame, changed: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack all documents."""
    import public_tokenizers

    return packing.query(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("duplicate_passages", duplicate_passages),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: SQL can express none of a trained model, 64-bit XXH fingerprints and a tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
