"""The queries and SQL that the entry module adds for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html, langid, packing, pieces, quality, secrets, simhash, substring, urls
from .common import table


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.query(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.query(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.query(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.query(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_urls": op2_urls,
    "op3_packing": op3_packing,
    "op4_pieces": op4_pieces,
    "op5_ann": op5_ann,
    "op6_substring": op6_substring,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
}

ORACLES: dict[str, str] = {"op2_urls": urls.ORACLE}
