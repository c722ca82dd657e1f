"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from attest.llm import packing, secrets
from tests.llm.common import prose
from tests.llm.test_simhash import plain_components
from tests.llm.test_substring import plain as plain_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's rows on the smallest tables, written and read as the pipeline does."""
    sf = "/root/testdata/sf0.001"
    top = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append((name, docs))
    return {n: (d.columns, {r.doc_id: r for r in d.collect()}, d.count()) for n, d in out}


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "duplicate_passages", "secret_scan", "packing"]


def test_columns_stay(steps):
    for name in ("language_id", "near_duplicates", "duplicate_passages", "secret_scan"):
        assert sorted(steps[name][0]) == sorted(steps["documents"][0])


def test_clean_documents_stay(steps):
    before, after = steps["documents"][1], steps["language_id"][1]
    gone = [r for i, r in before.items() if i not in after]
    assert len(gone) <= 0.05 * len(before)


def test_one_of_each_group_stays(steps):
    rows = [(i, r.text) for i, r in steps["language_id"][1].items()]
    want = {c for _, _, c in plain_components(rows)}
    assert set(steps["near_duplicates"][1]) == want


def test_passages_are_cut(steps):
    rows = [(i, r.text) for i, r in steps["near_duplicates"][1].items()]
    removed = {i: n for i, _, n, _ in plain_windows(rows)}
    for i, r in steps["duplicate_passages"][1].items():
        assert (r.text != steps["near_duplicates"][1][i].text) == (removed[i] > 0)
        assert r.n_chars == len(r.text)


def test_secrets_are_put_out(steps):
    after = steps["secret_scan"][1]
    assert len(after) == len(steps["duplicate_passages"][1])
    assert not any(secrets.base_spans(r.text) for r in after.values() if r.text)


def test_everything_is_packed(steps):
    assert set(steps["packing"][1]) == set(steps["secret_scan"][1])


def test_run_is_the_stages(spark, steps):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() == steps["packing"][2] and "sequence_id" in rows.columns


def test_odd_tables(spark):
    same = prose(60, 1)
    rows = [(1, same, "en", None, 1), (2, same, None, "s", None), (3, None, "en", "s", 0), (None, prose(50, 2), "en", "s", 5), (4, "", "en", "s", 0), (5, prose(40, 3) + " password=abcdefgh", "en", "s", 3), (5, prose(40, 4), "en", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0, name
        assert stage(spark, docs.withColumnRenamed("source", "source").withColumn("score", docs["n_chars"]), "").count() > 0, name
    assert packing.SIZE == 4096
