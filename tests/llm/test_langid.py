from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from attest.llm import langid
from tests.llm.common import ODD, read


def fitted(rows):
    counts = defaultdict(Counter)
    for lang, text in rows:
        counts[lang].update(langid.letters(text))
    return langid.fit(counts)


def plain_scores(rows, text):
    """The posterior of each language, step by step."""
    langs = sorted({x for x, t in rows if runs(t)})
    words = {x: Counter(w for y, t in rows if y == x for w in runs(t)) for x in langs}
    grams = {n: {x: Counter() for x in langs} for n in range(1, 5)}
    for n in grams:
        for x in langs:
            for w, k in words[x].items():
                padded = f"<{w}>" if n > 1 else w
                for i in range(len(padded) - n + 1):
                    grams[n][x][padded[i : i + n]] += k

    def row(of, name):
        total = {x: sum(of[x].values()) for x in langs}
        if not any(of[x][name] for x in langs):
            return None
        common = sum(of[x][name] for x in langs) / sum(total.values())
        return [math.log((of[x][name] + common + 1e-9) / (total[x] + 1)) - math.log(common) for x in langs]

    mean = [0.0] * len(langs)
    for w in runs(text):
        found = row(words, w)
        for n in (4, 3, 2, 1):
            if found is None:
                padded = f"<{w}>" if n > 1 else w
                some = [r for i in range(len(padded) - n + 1) if (r := row(grams[n], padded[i : i + n]))]
                found = [sum(c) / len(some) for c in zip(*some)] if some else None
        for j, v in enumerate(found or [0.0] * len(langs)):
            mean[j] += v / len(runs(text))
    top = max(mean)
    return {x: math.exp(v - top) / sum(math.exp(u - top) for u in mean) for x, v in zip(langs, mean)}


def runs(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def test_against_plain_scores(spark, sf):
    table = read(sf, "documents", "doc_id", "text", "lang")[:60]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table] + [(10_001, "Zwx qqqq und the de \u6f22\u5b57", None), (10_002, "x" * 70 + " \u00fcber", None)]
    learned = [(x, t) for i, t, x in rows if x is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    for r in langid.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = plain_scores(learned, text)
        assert r.score == pytest.approx(max(want.values()), abs=1e-9) and want[r.lang_pred] == pytest.approx(max(want.values()), abs=1e-12)


def test_rare_words_are_kept():
    m = fitted([("a", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}qq" for i in range(40_000 // 3))), ("b", "other words")])
    assert len(m.words.keys) == 40_000 // 3 + 2 and m.words.find(["aaaqq", "other"])[1].all()


def test_very_long_texts(monkeypatch):
    m = fitted([("a", "one two three"), ("b", "uno dos tres")])
    text = "one " * 150_000 + "uno " * 200_000
    assert m.predict([text])[0][0] == "b" and m.predict([text[::-1]]) is not None
    monkeypatch.setattr(langid, "PIECE", 999)
    assert m.predict([text, "one"])[1][0] == "a"


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.query(docs.select("doc_id", "text", "lang")).collect()
    return found, {r.doc_id: r for r in docs.collect()}


def test_held_out_accuracy(judged):
    found, docs = judged
    held = [r for r in found if r.held_out and docs[r.doc_id].lang is not None and langid.letters(docs[r.doc_id].text)]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)


def test_the_fold_is_by_crc(judged):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in judged[0])


def test_labels_of_the_fold_are_never_learned(spark):
    """Held-out rows with a label of their own: it must not be predicted."""
    rows = [(i, "uno dos tres" if i % 2 else "one two three", "es" if i % 2 else "en") for i in range(200)]
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    found = langid.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in found} == {"en", "es"}
    assert all(r.lang_pred == ("es" if r.doc_id % 2 else "en") for r in found)


def test_odd_rows(spark):
    rows = [(i, t, None) for i, t in ODD] + [(50 + i, "same words here", "en") for i in range(20)] + [(90, "12 !? ⅓", "en"), (91, "x" * 100_000, "en")]
    found = {}
    for r in langid.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(found[6]) == 2 and found[6][0] == found[6][1]
    assert all(found[i] == [("und", 0.0)] for i in (1, 2, 3, 90))
    nothing = langid.query(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert nothing.lang_pred == "und"
    assert langid.query(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_unseen_words_fall_back_to_ngrams_and_the_cache_changes_nothing(monkeypatch):
    m = fitted([("a", "abcab abcabc cabcab"), ("b", "xyzxy zyxzyx xyxyz")] * 5)
    assert [x for x, _ in m.predict(["bcabca", "yxzyxz"])] == ["a", "b"]
    texts = ["abcab zzz qqq xyzxy abcabc " * 3, None, "", "xyzxy", "12 ⅓", "abcab " * 20]
    want = m.predict(texts)
    for cache, piece in ((2, 2), (3, 1), (100, 7)):
        monkeypatch.setattr(langid, "CACHE", cache)
        monkeypatch.setattr(langid, "PIECE", piece)
        got = langid.Model(m.langs, m.words, m.grams).predict(texts)
        assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([p for _, p in got], [p for _, p in want])
    # A known word is scored by itself, whatever its n-grams.
    assert np.allclose(m.score(["abcab"])[0], m.words.rows[m.words.find(["abcab"])[0][0]])


def test_extra_columns_are_not_read(spark):
    rows = [(1, "a b", "x", 1.0), (2, "c d", "y", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    assert langid.query(df).columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_a_long_run_is_read_to_its_end(monkeypatch):
    m = fitted([("a", "abcab abcabc cabcab"), ("b", "xyzxy zyxzyx xyxyz")] * 5)
    run = "abc" * 22 + "xyz" * 100  # another language after character 64
    assert [x for x, _ in m.predict([run, "q" * 70 + "xyz" * 5])] == ["b", "b"]
    text = f"{run} abcab zzz {run[::-1]}"
    want = m.score(langid.letters(text))
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.allclose(m.score(langid.letters(text)), want)
