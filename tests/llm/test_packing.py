from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attest.llm import packing
from tests.llm.common import ODD, documents, prose, read

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_pieces(tok, rows):
    out = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            out.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def check(found, rows, tok):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == plain_pieces(tok, rows)
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by), -(-sum(r.length for r in found) // 4096)


def test_documents(spark, sf, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in read(sf, "documents", "doc_id", "text")]
    rows += ODD + [(9000, prose(9000, 1)), (9001, "<|endoftext|> a <|endoftext|>"), (9002, "x" * 50_000), (9003, "a\x1cb\x1d c\u00a0d\u2028e")]
    n, least = check(packing.query(documents(spark, rows), PATH).collect(), rows, tokenizer)
    assert n <= 1.03 * least + 1


def test_a_small_memory_changes_nothing(monkeypatch, tokenizer):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE", 5)
    own = packing.Encoder(PATH)
    for texts in (["one two three, four five six. seven"], [""], ["", "  eight nine", "one... ten eleven twelve"], [None, "   "], ["thirteen fourteen"]):
        ids, offsets = own.encode(pa.array(texts, pa.string()))
        for t, s, e in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
            assert ids[s:e].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("together", [1, 7, 300])
@pytest.mark.parametrize("clash", [False, True])
def test_windows_and_clashing_keys_change_nothing(monkeypatch, tokenizer, together, clash):
    import pyarrow as pa

    monkeypatch.setattr(packing, "TOGETHER", together)
    if clash:
        monkeypatch.setattr(packing, "_keys", lambda units: np.arange(len(units), dtype=np.uint64) % np.uint64(3))
    own = packing.Encoder(PATH)
    texts = [t for _, t in ODD] + ["x" * 200, " ", "  y", "z  ", prose(300, 1), None, prose(300, 2) + "\n" + "don't" * 50, "ab,cd" * 100, "", prose(300, 1)]
    for some in (texts, texts[::-1], texts[9:12], ["", ""], [None], texts[3:5]):
        ids, offsets = own.encode(pa.array(some, pa.string()))
        assert len(offsets) == len(some) + 1 and offsets[-1] == len(ids)
        for t, s, e in zip(some, offsets[:-1].tolist(), offsets[1:].tolist()):
            assert ids[s:e].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("texts", [1, 2000])
def test_memory_does_not_grow_with_the_texts_at_once(texts):
    import tracemalloc

    import pyarrow as pa

    own = packing.Encoder(PATH)
    words = prose(1000, 3)
    each = (words + " ") * (8_000_000 // texts // len(words) or 1)
    some = pa.array([each] * texts, pa.string())
    own.encode(pa.array([words]))
    tracemalloc.start()
    ids, _ = own.encode(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The ids themselves are there twice for a moment, as parts and as a whole.
    assert peak < 8 * len(ids) + 50_000_000


def test_a_long_unit_takes_no_many_times_its_memory():
    import tracemalloc

    import pyarrow as pa

    units = pa.array([b"a", b"x'" * 4_000_000], pa.binary())
    tracemalloc.start()
    packing._keys(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24_000_000


def test_an_empty_table(spark):
    assert packing.query(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("kind", ["small", "mixed", "large", "one_length", "thirds"])
def test_plans_use_few_sequences(kind):
    r = random.Random(kind)
    lengths = {
        "small": lambda: r.randrange(1, 300),
        "mixed": lambda: min(4096, int(r.lognormvariate(6, 1.2)) + 1),
        "large": lambda: r.randrange(1500, 4097),
        "one_length": lambda: 1000,
        "thirds": lambda: r.choice((1365, 1366, 1365)),
    }[kind]
    counts = np.zeros(4097, np.int64)
    for _ in range(20_000):
        counts[lengths()] += 1
    groups, n = packing.plan(counts)
    used = np.zeros(4097, np.int64)
    for parts, copies in groups:
        assert sum(parts) <= 4096
        for x in parts:
            used[x] += copies
    assert (used == counts).all() and n == sum(c for _, c in groups)
    # Best-fit decreasing, one piece at a time, is what it must not fall behind.
    rooms: list[int] = []
    from bisect import bisect_left, insort

    for x in np.repeat(np.arange(4096, 0, -1), counts[:0:-1]).tolist():
        at = bisect_left(rooms, x)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else 4096) - x)
    assert n <= 1.01 * len(rooms) + 2


def test_nnls_against_conditions():
    r = np.random.default_rng(0)
    a, b = r.random((20, 35)), r.random(20) * 10
    x = packing.nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w < 1e-6).all() and np.abs(w[x > 0]).max() < 1e-6


def test_patterns():
    found = packing.patterns(8, 3)
    assert len(set(found)) == len(found) and all(sum(p) == 8 and len(p) <= 3 and list(p) == sorted(p, reverse=True) for p in found)


def test_a_common_length_is_spread(spark):
    cut = spark.createDataFrame([(i, 0, 0, 7 if i % 3 else 5, i) for i in range(3000)], packing.PIECES)
    rows = packing.pack(cut).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 3000


def test_repeats_of_one_row_are_dealt_out(spark, tokenizer):
    rows = [(None, "the same words")] * 1000
    cut = packing.written(packing.pieces(documents(spark, rows), PATH).withColumn("_salt", F.monotonically_increasing_id()))
    assert cut.selectExpr("pmod(xxhash64(doc_id, piece, ids_crc32, _salt), 64) as b").groupBy("b").count().agg(F.max("count")).first()[0] < 60
    n, least = check(packing.query(documents(spark, rows), PATH).collect(), rows, tokenizer)
    assert n <= 1.03 * least + 1


def test_other_columns_with_names_of_the_result(spark, tokenizer):
    df = spark.createDataFrame([(1, "some words", 5, 6, "x"), (2, None, None, None, None)], "doc_id long, text string, length long, offset long, _bucket string")
    found = packing.query(df, PATH).collect()
    check(found, [(1, "some words"), (2, None)], tokenizer)


def test_units_of_all_kinds_are_as_the_library_has_them(tokenizer):
    import pyarrow as pa

    r = random.Random(11)
    signs = ["a", "B", "z", "\u00c9", "\u00df", "\u00d7", "\u00f7", "\u0130", "\u0131", "\u0301", "\u0393", "\u03a3", "\u6f22", "\u00a0", "\u2028", "\U0001f600", "0", "9", "\u0663", "'", "'s", "'LL", "<|", "|>", "<|endoftext|>", ".", ",!", "_", "\x01", "\x1c", "\x7f", " ", "  ", "\t", "\n", "\u01c5", "\u0240", "J\u030c", "\u1e9e"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 30))) for _ in range(3000)] + [None, ""]
    texts += [form.format(chr(c)) for c in range(0x80, 0x260) for form in ("a{0}b", ".{0}!", "{0}", "9{0}{0}'")]
    own = packing.Encoder(PATH)
    for some in (texts, texts[::-1]):
        ids, offsets = own.encode(pa.array(some, pa.string()))
        for t, s, e in zip(some, offsets[:-1].tolist(), offsets[1:].tolist()):
            assert ids[s:e].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
