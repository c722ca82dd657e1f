from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash

from attest.llm import simhash
from tests.llm.common import ODD, documents, prose, read, words


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, tau: int = 4):
    """Every pair compared."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            t = top(i)
            least[t] = min(least.get(t, doc), doc)
    return Counter((doc, f"{fps[i]:016x}", least.get(top(i))) for i, (doc, _) in enumerate(rows))


def got(spark, rows):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(documents(spark, rows)).collect())


def test_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(sf, "documents", "doc_id", "text")]
    base = prose(300, 1).split()
    near = []
    for i in range(12):  # a chain of near copies
        base[i * 20] = f"changed{i}"
        near.append((10_000 + i, " ".join(base)))
    rows += near
    assert got(spark, rows) == plain_components(rows)


def test_odd_rows(spark):
    assert got(spark, ODD) == plain_components(ODD)
    assert got(spark, []) == Counter()


def test_links_of_made_up_fingerprints(spark):
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(30):
            x = c
            for b in r.choice(64, r.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((e.src ^ e.dst) & (1 << 64) - 1).bit_count() <= 4
        root[top(e.src)] = top(e.dst)
    every = list(fps)
    for i, a in enumerate(every):
        for b in every[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert top(a) == top(b)


def test_thresholds_obey_the_principle():
    r = np.random.default_rng(1)
    sample = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    parts = simhash.allocate(sample, 1_000_000)
    assert sum(t + 1 for _, t in parts) == simhash.TAU + 1
    bits = [b for g, _ in parts for b in g]
    assert len(bits) == len(set(bits))


def test_large_buckets_are_split_exactly():
    r = np.random.default_rng(5)
    fps = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    fps[2000:] = fps[:2000] ^ (np.uint64(1) << r.integers(0, 60, 2000).astype(np.uint64))
    fps = np.unique(fps)
    out: list[np.ndarray] = []
    simhash._verify(fps, np.ones(len(fps), bool), 4, list(range(64)), out)
    pairs = {frozenset(p) for p in np.concatenate(out).tolist()}
    assert len(pairs) >= 1990


def test_representatives_keep_the_smallest(spark):
    rows = [(5, "a b c d e", "x"), (3, "a b c d e", "y"), (9, "f g h i j", "z"), (9, "k l m n o", "z"), (9, "k l m n o", "z"), (None, "p q r s t", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(simhash.representatives(df).collect(), key=str)
    assert [(r.doc_id, r.text) for r in found] == [(3, "a b c d e"), (9, "f g h i j"), (9, "k l m n o"), (None, "p q r s t")]


def test_very_long_texts_and_other_columns(spark):
    long = " ".join(str(i * i % 9973) for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 400_000), (4, "again " * 100_000)]
    df = spark.createDataFrame([(*r, 5, "r", 7) for r in rows], "doc_id long, text string, fp int, root string, component_id int")
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(df).collect())
    assert found == plain_components(rows)
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == [1, 3, 4]


def test_small_partitions_give_the_same(spark, monkeypatch):
    base = prose(200, 5).split()
    rows = [(i, " ".join(base[: 150 + i % 50])) for i in range(60)] + [(100 + i, prose(40, i)) for i in range(30)]
    monkeypatch.setattr(simhash, "MEET", 50)
    assert got(spark, rows) == plain_components(rows)
