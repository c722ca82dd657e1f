from __future__ import annotations

import datetime
import hashlib
import random
from collections import Counter

import numpy as np

from attest.llm import substring
from tests.llm.common import ODD, documents, prose, read, words

W = substring.WINDOW


def plain(rows):
    """Every window of every text, counted."""
    windows = Counter(tuple(w[i : i + W]) for _, t in rows for w in [words(t)] for i in range(len(w) - W + 1))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - W + 1):
            if windows[tuple(w[i : i + W])] > 1:
                gone[i : i + W] = [True] * W
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return Counter(out)


def got(spark, rows):
    return Counter(map(tuple, substring.query(documents(spark, rows)).collect()))


def test_against_all_windows(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(sf, "documents", "doc_id", "text")]
    assert got(spark, rows) == plain(rows)


def test_planted_passages(spark):
    r = random.Random(4)
    passages = [prose(n, 100 + n) for n in (34, 35, 36, 50, 120)]
    rows = []
    for i in range(60):
        parts = [prose(r.randrange(5, 60), i), r.choice(passages), prose(r.randrange(5, 60), 1000 + i)]
        if i % 7 == 0:
            parts.append(parts[1])  # twice in one text
        rows.append((i, " ".join(parts)))
    rows += [(60, "x " * 40), (61, "x " * 200), (62, "y " * 35), (63, "y " * 36), (64, prose(300, 9)), (65, prose(300, 9) + " more")]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(40))
    rows = ODD + [(20, long), (20, long), (None, long), (21, long.replace(" ", "\t\n "))]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == Counter()


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 2000)
    passage = prose(60, 7)
    rows = [(i, f"{prose(30, i)} {passage if i % 3 else ''} {prose(30, 500 + i)}") for i in range(40)]
    assert got(spark, rows) == plain(rows)


def test_cleaned_texts_keep_other_columns(spark):
    passage = prose(50, 3)
    rows = [(1, f"own words\n{passage}", "s", None), (2, f"{passage} others", None, 5), (3, "untouched  text\n", "t", 1), (4, None, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = sorted(map(tuple, substring.cleaned(df).collect()))
    assert found == [(1, "own words", "s", None), (2, "others", None, 5), (3, "untouched  text\n", "t", 1), (4, None, "t", 1)]


def test_factors_against_all_windows():
    for seed in range(120):
        r = random.Random(seed)
        window = r.choice([3, 5, 8])
        vocabulary = [chr(97 + i).encode() for i in range(r.choice([1, 2, 3, 6]))]
        phrases = sorted({b" ".join(r.choice(vocabulary) for _ in range(r.randrange(window, 90))) for _ in range(r.randrange(1, 8))})
        copies = np.array([r.choice([1, 1, 1, 2]) for _ in phrases])
        counted = Counter(tuple(w[i : i + window]) for p, n in zip(phrases, copies) for w in [p.split()] for i in range(len(w) - window + 1) for _ in range(n))
        for p, flags in zip(phrases, substring.duplicates(phrases, copies, window)):
            w = p.split()
            assert flags.tolist() == [counted[tuple(w[i : i + window])] > 1 for i in range(len(w) - window + 1)]


def test_factors_are_greedy_and_longest():
    r = random.Random(1)
    phrases = [b" ".join(r.choice([b"a", b"b", b"c"]) for _ in range(40)) for _ in range(4)]
    reference = substring.Reference(phrases)
    split = [p.split() for p in phrases]
    found = substring.factors(reference, reference.longest(), np.arange(4))
    for k, w in enumerate(split):
        at = 0
        for which, s, e in zip(*(x.tolist() for x in found)):
            if which == k:
                s, e = s - int(reference.starts[k]), e - int(reference.starts[k])
                assert s == at
                most = max((n for j, v in enumerate(split) for i in range(len(v)) if (j, i) != (k, s) for n in [_common(w[s:], v[i:])]), default=0)
                assert e - s == max(1, most)
                at = e
        assert at == len(w)


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_a_crowded_passage_in_ever_other_surroundings(spark, monkeypatch):
    for block in (substring.BLOCK, 4000):
        monkeypatch.setattr(substring, "BLOCK", block)
        passages = [prose(n, 7) for n in (36, 45, 60, 200)]
        rows = [(i, f"{prose(40, 9000 + i)} {passages[i % 4]} {prose(40, 5000 + i)}") for i in range(160)]
        rows += [(200 + i, f"{prose(12, 40 + i // 2)} {prose(20, 7)} {prose(30, 60 + i // 2)}") for i in range(120)]  # pairs around a common middle
        assert got(spark, rows) == plain(rows)


def test_crowded_anchors_give_no_reference_rows(spark):
    phrases = [(i % 9, 5, i, 1, f"{prose(20, i)} {prose(20, 1)}".encode()) for i in range(3 * substring.CROWD)] + [(0, 6, 900, 1, prose(36, 2).encode()), (1, 6, 901, 1, f"{prose(36, 2)} more".encode())]
    df = spark.createDataFrame(phrases, "block int, anchor long, phrase long, n tinyint, words binary")
    assert {(r.block, r.phrase) for r in substring._marked(df, 4).collect()} == {(0, 900), (1, 901)}


def test_very_long_texts(spark):
    r = random.Random(6)
    long = " ".join(str(r.randrange(10**6)) for _ in range(120_000))
    middle = " ".join(long.split()[60_000:60_100])
    rows = [(1, long), (2, f"own {middle} end"), (3, "again " * 110_000), (4, "x" * 300_000 + " y"), (5, " ".join(long.split()[119_960:]))]
    assert got(spark, rows) == plain(rows)


def test_other_columns_and_clashing_names(spark):
    stamp = datetime.datetime(2024, 5, 1, 2, 3, 4, 123456)
    rows = [(1, prose(50, 3), 5, "k", 7, stamp, "a.b"), (2, prose(50, 3) + " more", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, kind string, anchor long, at timestamp, `a.b` string")
    assert got_frame(substring.query(df)) == plain([r[:2] for r in rows])
    found = sorted(map(tuple, substring.cleaned(df).collect()))
    assert found == [(1, "", 5, "k", 7, stamp, "a.b"), (2, "more", None, None, None, None, None)]


def got_frame(df):
    return Counter(map(tuple, df.collect()))


def test_very_many_repeats_of_one_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 2000)
    rows = [(None, prose(40, 1))] * 300 + [(i, prose(20, 100 + i)) for i in range(20)]
    df = documents(spark, rows)
    blocks = substring.dealt(df.select("doc_id", "text"))[0].groupBy("block").count().collect()
    assert max(r["count"] for r in blocks) < 60
    assert got(spark, rows) == plain(rows)
