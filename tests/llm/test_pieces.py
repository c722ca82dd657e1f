from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from attest.llm import pieces
from tests.llm.common import ODD, documents, read

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in read(sf, "documents", "doc_id", "text")] + ODD
    found = {(r.doc_id, r.n_ids, r.ids_crc32) for r in pieces.query(documents(spark, rows), PATH).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "")
        want.add((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert found == want


def test_any_text_and_the_way_back(spark, library):
    r = random.Random(5)
    signs = "aAbBeEtTnNoO    .,-_'\n\t▁éü漢😀½\x00<s>"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 60))) for _ in range(300)] + ["", " ", "  a  ", "▁", "a▁b", "x" * 5000]
    own = pieces.coder(PATH)
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    for t, s, e in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
        assert ids[s:e].tolist() == library.encode(t), t
        assert own.decode_bytes(ids[s:e]).decode() == t.replace("▁", " ")


def test_compatible_pairs_are_those_that_merging_leaves_alone():
    own = pieces.coder(PATH)
    r = np.random.default_rng(1)
    a, b = r.integers(0, len(own.usable), 4000), r.integers(0, len(own.usable), 4000)
    # Pairs that share an edge, so that many merge.
    a[:2000], b[:2000] = r.integers(0, 3000, 2000), r.integers(0, 3000, 2000)
    got = own._compatible(a, b)
    want = [own._merge(own.usable[i] + own.usable[j])[0] == [own.usable[i], own.usable[j]] for i, j in zip(a, b)]
    assert got.tolist() == want and 0 < got.sum() < len(got)


def test_slices_and_a_small_memory(monkeypatch, library):
    texts = [f"número {i} ça et {i * 7} là." for i in range(300)] + [None, ""] * 3
    own = pieces.Coder(PATH)
    monkeypatch.setattr(pieces, "CACHE", 50)
    monkeypatch.setattr(pieces, "INDEXED", 64)
    for s in (0, 100, 290):
        ids, offsets = own.encode(pa.array(texts).slice(s, 100))
        for t, i, j in zip(texts[s : s + 100], offsets[:-1].tolist(), offsets[1:].tolist()):
            assert ids[i:j].tolist() == library.encode(t or "")


def test_round_trip_in_tables(spark):
    rows = [(1, "some words, and more"), (2, None), (3, ""), (None, "漢字 and   spaces "), (4, "a\nb")]
    coded = pieces.encoded(documents(spark, rows), PATH, with_ids=True)
    back = {(r.doc_id, r.text) for r in pieces.decoded(coded, PATH).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert all(r.exact for r in coded.collect())
    assert pieces.query(documents(spark, []), PATH).count() == 0


def test_the_query_returns_the_ids(spark):
    rows = [(i, t) for i, t in ODD if i is not None]
    found = pieces.query(documents(spark, rows), PATH)
    assert all(len(r.ids) == r.n_ids and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found.collect())
    assert {(r.doc_id, r.text) for r in pieces.decoded(found, PATH).collect()} == {(i, t or "") for i, t in rows}


def test_very_long_texts_and_other_columns(spark, library):
    r = random.Random(8)
    long = [" ".join(str(r.randrange(10**6)) for _ in range(100_000)), "x" * 60_000, "word " * 200_000]
    df = spark.createDataFrame([(i, t, 1, "y", [7]) for i, t in enumerate(long)], "doc_id long, text string, n_ids int, exact string, ids array<int>")
    found = {x.doc_id: x for x in pieces.query(df, PATH).collect()}
    for i, t in enumerate(long):
        assert found[i].ids == library.encode(t) and found[i].exact


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(4, "same words"), (4, "same words"), (None, "same words")]
    assert len({tuple(x.ids) for x in pieces.query(documents(spark, rows), PATH).collect()}) == 1
    assert pieces.query(documents(spark, rows), PATH).count() == 3 and pieces.query(documents(spark, []), PATH).count() == 0
