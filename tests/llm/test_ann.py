from __future__ import annotations

import math

import numpy as np
import pytest

from attest.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain(rows, every: int = 50, k: int = 5):
    """All pairs in double precision."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    ids = sorted(good)
    m = np.stack([good[i] for i in ids])
    out = {}
    for q in (i for i in ids if i % every == 0):
        s = (m * good[q]).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((good[q] ** 2).sum()))
        out[q] = sorted((-x, i) for x, i in zip(s.tolist(), ids) if i != q)[:k]
    return out


def test_recall_and_exact_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    r = np.random.default_rng(0)
    rows += [(10_000 + i, r.normal(size=len(rows[0][1])).astype(np.float32).tolist()) for i in range(1500)]
    want, hits, total = plain(rows), 0, 0
    found: dict = {}
    for x in ann.query(table(spark, rows)).collect():
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(found) == set(want)
    for q, best in want.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        exact = {i: -s for s, i in best}
        hits += sum(g[1] in exact for g in got)
        total += 5
        for _, i, s in got:
            if i in exact:
                assert s == pytest.approx(exact[i], abs=1e-12)
    assert hits / total >= 0.95


def test_ties_copies_and_bad_vectors(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, one), (50, two)] + [(i, one) for i in (9, 7, 5, 3, 1, 11, 13)] + [(100, None), (150, [0.0, 0.0, 0.0]), (200, [float("nan"), 1.0, 0.0]), (2, [1.0, None, 0.0]), (4, [float("inf"), 0.0, 0.0]), (None, one), (6, [1.0, 0.0]), (1, one)]
    found: dict = {}
    for r in ann.query(table(spark, rows)).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == {0, 50}
    assert [found[0][k][0] for k in range(1, 6)] == [1, 3, 5, 7, 9]
    assert [found[50][k] for k in range(1, 6)] == [(0, 0.0), (1, 0.0), (3, 0.0), (5, 0.0), (7, 0.0)]


def test_few_candidates_and_none(spark):
    found = ann.query(table(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 1)]
    assert ann.query(table(spark, [])).count() == 0 and ann.query(table(spark, [(0, [1.0])])).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    want = plain(rows)
    monkeypatch.setattr(ann, "ROWS", 30)
    monkeypatch.setattr(ann, "QUERIES", 4)
    monkeypatch.setattr(ann, "PER_LIST", 60)
    got: dict = {}
    for x in ann.query(table(spark, rows)).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = sum(len(got[q] & {i for _, i in best}) for q, best in want.items())
    assert hits / (5 * len(want)) >= 0.95


def recall(found, want):
    got: dict = {}
    for x in found:
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert all(len(got[q]) == min(5, len(best)) for q, best in want.items())
    return sum(len(got[q] & {i for _, i in best}) for q, best in want.items()) / sum(map(len, want.values()))


def test_few_lists_are_looked_into_where_data_has_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 100)
    monkeypatch.setattr(ann, "ROWS", 700)
    r = np.random.default_rng(6)
    middles = r.normal(size=(40, 24))
    of = np.where(r.random(4000) < 0.33, 0, r.integers(0, 40, 4000))  # a third of all rows in one cluster
    x = (middles[of] + 0.15 * r.normal(size=(4000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(ann.query(table(spark, rows)).collect(), plain(rows)) >= 0.95
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(float)
    centres = ann.coarse(unit, 40)
    assert ann.looks(unit, centres, 5) <= 20 and ann.looks(unit[:3], centres[:1], 5) == 1


def test_a_query_in_an_empty_corner_still_gets_five(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 20)
    monkeypatch.setattr(ann, "RECALL", 0.5)
    r = np.random.default_rng(7)
    x = np.concatenate((r.normal(size=(300, 6)) + 9, [[-5.0, 1, 0, 0, 0, 0]])).astype(np.float32)
    rows = [(1 + i, v.tolist()) for i, v in enumerate(x[:-1])] + [(1000, x[-1].tolist())]
    found = [q for q in ann.query(table(spark, rows)).collect() if q.query_id == 1000]
    assert sorted(q.rank for q in found) == [1, 2, 3, 4, 5]


def test_one_id_with_two_vectors_and_other_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 2), (7, [0.0, 1.0], 1, 2), (7, [1.0, 0.1], 1, 2), (8, [1.0, 1.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, q int")
    assert [(r.rank, r.vec_id) for r in sorted(ann.query(df).collect())] == [(1, 7), (2, 8)]


def test_parallel_error_is_what_the_quantiser_avoids():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def parallel(aim):
        q = ann.Quantiser(x, aim=aim)
        c = q.code(x)
        back = np.concatenate([q.centres[i][c[:, i]] for i in range(len(q.spaces))], axis=1)
        return float((((back - x) * x).sum(1) ** 2).mean())

    assert parallel(0.5) < parallel(0.0)


def test_near_and_scaled_copies_of_a_third_of_a_block_lose_nothing():
    r = np.random.default_rng(4)
    n, d = 4096, 64
    x = r.normal(size=(n, d))
    crowd = r.permutation(n)[: n // 3]
    centre = r.normal(size=d)
    near, scaled = crowd[::2], crowd[1::2]
    x[near] = centre + 0.1 * r.normal(size=(len(near), d))
    x[scaled] = centre * 2.0 ** r.integers(-3, 4, len(scaled))[:, None]
    x = x.astype(np.float32).astype(np.float64)
    x[scaled] = x[scaled[0]] * 2.0 ** r.integers(-3, 4, len(scaled))[:, None]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(n)
    asked = np.concatenate((near[:20], scaled[:20], np.setdiff1d(ids, crowd)[:20]))
    found = ann.search_block(ann.Quantiser(unit), asked, x[asked], ids, x)
    for q in asked.tolist():
        s = ann._cosine(x[q][None], x)
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if i != q)[:5]
        part = found[found["query_id"] == q]
        assert list(zip((-part["score"]).tolist(), part["vec_id"].tolist())) == want
