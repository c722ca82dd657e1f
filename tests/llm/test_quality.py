from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attest.llm import quality
from tests.llm.common import ODD, prose, read, words


def plain_base(text: str | None):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def judge(spark, rows, labels, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"), **how).collect()


def test_base_rules_against_python(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(sf, "documents", "doc_id", "text")] + ODD
    block = prose(12, 1)
    rows += [(900, f"{block} {block} {block}"), (901, "a\na\n a\na \n\n\nb\nb"), (902, "w " * 50), (903, f"{block} x {block}\n{prose(40, 2)}"), (904, "# * $ % & | < > ^")]
    found = judge(spark, rows, [(1, 1)])
    want = Counter((i, *plain_base(t)) for i, t in rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == want


def test_scores_against_python(spark):
    rows = [(i, prose(30, i % 7)) for i in range(30)] + [(99, None)]
    labels = [(i, int(i % 2 == 0)) for i in range(20)] + [(None, 1), (2, 1), (500, 1)]
    buckets = 64
    texts = [[w for w in words(t)] for _, t in rows]
    flat = sorted({w for t in texts for w in t})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in flat], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(h[a], h[b]) for t in texts for a, b in zip(t, t[1:])})
    hp = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = [[h[w] % buckets for w in t] + [hp[h[a], h[b]] % buckets for a, b in zip(t, t[1:])] for t in texts]
    trusted = {i for i, q in labels if q and i is not None}
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        if i in trusted:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = [math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in range(buckets)]
    found = {r.doc_id: r for r in judge(spark, rows, labels, buckets=buckets, threshold=0.0)}
    for (i, _), g in zip(rows, grams):
        want = sum(weight[b] for b in g) / max(1, len(g))
        assert found[i].score == pytest.approx(want, abs=1e-8)
        assert found[i].kept == (not found[i].base_failed and found[i].score >= 0.0)


def test_good_documents_are_kept_and_bad_ones_are_not(spark):
    top = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")
    found = quality.query(docs.select("doc_id", "text"), labels).join(labels, "doc_id").filter("not base_failed")
    kept = {r.quality: r.k for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.97 and kept.get(0, 0) < 0.5


def test_odd_tables(spark):
    assert judge(spark, [], []) == []
    (r,) = judge(spark, [(1, prose(30, 1))], [])
    assert r.kept and r.score == 0.0
    twice = judge(spark, [(1, prose(30, 1))] * 2, [(1, 1), (1, 1)])
    assert len(twice) == 2 and twice[0] == twice[1]
    wide = spark.createDataFrame([(1, prose(30, 1), "x", 3)], "doc_id long, text string, words string, score int")
    assert quality.judged(wide, spark.createDataFrame([(1, 1, "y")], "doc_id long, quality int, text string")).count() == 1


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, prose(30, 1))], "doc_id long, text string")
    plan = quality.judged(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_very_long_texts_and_other_columns(spark):
    long = " ".join(str(i * i % 99_991) for i in range(60_000))
    rows = [(1, long), (2, "again " * 30_000), (3, "x" * 300_000), (4, "line\n" * 20_000)]
    docs = spark.createDataFrame([(*r, 1, [2], "k") for r in rows], "doc_id long, text string, n_words int, h array<int>, kept string")
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, text string")
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(docs, labels).collect())
    assert found == Counter((i, *fast_base(t)) for i, t in rows)


def fast_base(text: str):
    """plain_base in linear time."""
    w = words(text)
    seen: set[str] = set()
    dup = 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)
