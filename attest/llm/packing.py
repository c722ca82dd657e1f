"""Best-fit packing of tokenised documents, planned by patterns and non-negative least squares.

A plan needs the histogram of piece lengths only, which has at most ``size`` rows however many documents there are.
``patterns`` enumerates few-document patterns over coarse length bins that fill a sequence exactly, ``nnls`` fits
how often each should be repeated to match the histogram, the counts are rounded down, each repetition draws exact
lengths from its bins and closes with the longest piece that fits, and what is left is packed best-fit decreasing,
into the patterns' slack too.  The plan is a list of slots, each a run of equal-length pieces at one offset, and its
size depends on the number of lengths and patterns, not of documents, so it may be broadcast.

Every piece then takes a rank among the pieces of its length.  Ranks come from counts by (length, bucket) and a row
number inside each bucket, so that a length which a third of all pieces share is still spread out.

Cases: a null or empty text is one token, the closing id; a text of more than ``size`` tokens is cut, and only that;
repeated rows are packed each on its own; a null doc_id is kept; an empty table packs to nothing; other columns are
not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, written

SIZE = 4096
END = 1
#: UTF-8 bytes of text that are split together; arrays of many times that size are held meanwhile.
TOGETHER = 1 << 20
#: Units whose ids a worker remembers, in some 50 bytes each; beyond it, it starts anew.
CACHE = 1_500_000
#: Bins of the patterns, and most documents in one.
BINS, PARTS = 64, 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Between units that are encoded together.
_GAP = "\x01"

#: What a byte is: white space, part of a letter, a digit, a sign, or anything else, which keeps its run whole.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[33:127] = _SIGN
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[39] = _ODD  # an apostrophe may begin a contraction
# U+00C0 to U+023F are letters but for two signs; these are their first bytes, and all that follow.
_KINDS[0xC3:0xC9] = _KINDS[0x80:0xC0] = _LETTER


def _keys(units: pa.Array) -> np.ndarray:
    """A 64-bit hash of each unit's bytes."""
    return pd.util.hash_array(np.array(units.to_pylist(), object), categorize=False)


def _windows(raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of one to two times TOGETHER bytes, or all; they end at a text's end or white space, so no unit is cut."""
    step = -(-len(raw) // max(1, len(raw) // TOGETHER))
    first = 0
    while first < len(raw):
        at = min(first + step, len(raw))
        last = int(edges[np.searchsorted(edges, at)])
        for s in range(at, last, 1 << 16):
            found = np.flatnonzero(_KINDS[raw[s : min(s + (1 << 16), last)]] == _SPACE)
            if len(found):
                last = s + int(found[0])
                break
        yield first, last
        first = last


class Encoder:
    """A tokenizer whose units are encoded once and remembered.

    This vocabulary's tokens hold no white space and don't mix letters, digits and other signs, and case is dropped.  So a
    text's ids are those of its units: runs of Latin letters, single digits and runs of signs, found for many texts
    at once on their bytes.  A run between white space with anything else in it (an apostrophe, other scripts,
    combining or control characters, the start of a special token) is one unit, encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.gap = self.tok.encode(_GAP, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.binary())
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        #: The units' keys in order, and which unit each is of.
        self.keys = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int32)

    def _learn(self, units: pa.Array) -> None:
        texts = [u.decode("utf-8", "replace") for u in units.to_pylist()]
        parts, sizes = [self.ids], []
        for at in range(0, len(texts), 1000):
            some = texts[at : at + 1000]
            ids = np.array(self.tok.encode(f" {_GAP} ".join(some), add_special_tokens=False).ids, np.uint32)
            gaps = np.flatnonzero(ids == self.gap[0]) if len(self.gap) == 1 else []
            if len(gaps) == len(some) - 1:
                parts.append(np.delete(ids, gaps))
                sizes.append(np.diff(gaps, prepend=-1, append=len(ids)) - 1)
            else:  # a unit holds what stands between them
                each = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast(some, add_special_tokens=False)]
                parts += each
                sizes.append(np.array([len(x) for x in each]))
        self.units = pa.concat_arrays([self.units, units])
        self.ids = np.concatenate(parts)
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))))

    def _known(self, units: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit is, and whether it is there; keys may clash, so units themselves are compared."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        place, there = self.order[at].astype(np.int64), self.keys[at] == keys
        there[there] = pc.equal(self.units.take(pa.array(place[there])), units.filter(pa.array(there))).to_numpy(zero_copy_only=False)
        return place, there

    def _find(self, units: pa.Array) -> np.ndarray:
        """Where each of some different units is among those remembered."""
        keys = _keys(units)
        place, there = self._known(units, keys)
        more = len(units) - int(there.sum())
        if more and (len(self.units) + more > CACHE or self.units.nbytes > 40 * CACHE):
            self._forget()
            place, there = self._known(units, keys)
        new = np.flatnonzero(~there)
        if len(new):
            place[new] = len(self.units) + np.arange(len(new))
            new = new[np.argsort(keys[new])]
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.order = np.insert(self.keys, at, keys[new]), np.insert(self.order, at, place[new])
            self._learn(units.filter(pa.array(~there)))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
        edges = (edges - edges[0]).astype(np.int64)
        parts, n, ends = [np.zeros(0, np.uint32)], 0, np.zeros(len(edges), np.int64)
        for first, last in _windows(raw, edges):
            inside = slice(*np.searchsorted(edges, (first, last)))
            ids, at = self._encode(raw[first:last], edges[inside] - first)
            ends[inside] = n + at
            parts.append(ids)
            n += len(ids)
        ends[edges == len(raw)] = n
        return np.concatenate(parts), ends

    def _encode(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some bytes, and where those from each edge on begin."""
        kind = _KINDS[raw]
        solid = kind != _SPACE
        before = np.where(edges > 0, np.cumsum(solid, dtype=np.int32)[edges - 1], 0)
        head = np.ones(len(raw) + 1, bool)
        head[1:-1] = ~solid[:-1]
        head[edges] = True
        raw, kind, head = raw[solid], kind[solid], head[:-1][solid]
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        # The multiplication and the division sign, a capital whose small form is a letter and a mark, and the start of a special token.
        pair = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC4) & (raw[1:] == 0xB0) | (raw[:-1] == 60) & (raw[1:] == 124)
        kind[:-1][pair] = _ODD
        runs = np.flatnonzero(head)
        whole = np.repeat(np.maximum.reduceat(kind, runs) == _ODD, np.diff(runs, append=len(raw)))
        cut = kind == _DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut = cut & ~whole | head
        raw |= ((raw >= 65) & (raw <= 90) & ~whole).view(np.uint8) << 5
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        at = self._find(units.dictionary)[units.indices.to_numpy()]
        first = self.bounds[at]
        each = self.bounds[at + 1] - first
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = self.ids[np.repeat(first - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, before)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    return Encoder(path)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to TOGETHER bytes, as words are looked up once for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TOGETHER:
            whole, held = pa.Table.from_batches(held).combine_chunks(), []
            yield from whole.to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            bytes_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(bytes_to)) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                if last == first:
                    continue
                rows = batch.slice(first, last - first)
                ids, offsets = encoder(tokenizer).encode(rows.column("text"))
                out = []
                for i in range(rows.num_rows):
                    mine = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end)).astype("<u4")
                    for k, s in enumerate(range(0, len(mine), size)):
                        part = mine[s : s + size]
                        out.append((i, k, s, len(part), zlib.crc32(part)))
                row, *columns = np.array(out, np.int64).T
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                arrays = [rows.column("doc_id").take(pa.array(row)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            release()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


# --- the plan --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def patterns(bins: int = BINS, parts: int = PARTS) -> tuple[tuple[int, ...], ...]:
    """All multisets of up to ``parts`` bins that sum to ``bins``, largest first."""

    def grow(left: int, most: int, room: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif room:
            for b in range(min(left, most), 0, -1):
                if b * room < left:
                    break
                for rest in grow(left - b, b, room - 1):
                    yield (b, *rest)

    return tuple(grow(bins, bins, parts))


def nnls(a: np.ndarray, b: np.ndarray, most: int = 0) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|: active sets, as Lawson and Hanson describe."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * (np.abs(b).max(initial=0) + 1e-300) * np.abs(a).sum(0).max(initial=1)
    for _ in range(most or 6 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if len(z) == 0 or z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = (x[at][bad] / (x[at][bad] - z[bad] + 1e-300)).min()
            x[at] += step * (z - x[at])
            passive[at[(x[at] <= 1e-12) & bad]] = False
            x[~passive] = 0
    return x


def plan(counts: np.ndarray, size: int = SIZE) -> tuple[list[tuple[list[int], int]], int]:
    """Groups (lengths in order, copies) that pack counts[L] pieces of each length L, and the number of sequences."""
    left = counts.astype(np.int64).copy()
    groups: list[list] = []  # [lengths, copies]
    if left[size]:
        groups.append([[size], int(left[size])])
        left[size] = 0
    width = size // BINS
    if left.sum() and width:
        bins = (np.arange(size + 1) + width - 1) // width
        have = np.bincount(bins, weights=left, minlength=BINS + 1)[1:]
        pats = patterns()
        a = np.zeros((BINS, len(pats)))
        for j, p in enumerate(pats):
            for part in p:
                a[part - 1, j] += 1
        # A miss on long pieces costs more, since short ones fit in anywhere.
        weight = np.sqrt(np.arange(1, BINS + 1))
        fit = nnls(a * weight[:, None], have * weight)
        for j in np.argsort(-fit, kind="stable"):
            k = int(fit[j])
            while k > 0:
                chosen: list[int] = []
                room = size
                for i, part in enumerate(pats[j]):
                    low, high = (part - 1) * width, part * width
                    top = room if i == len(pats[j]) - 1 else min(high, room)
                    used = np.zeros(size + 1, np.int64)
                    np.add.at(used, chosen, 1)
                    free = np.flatnonzero(left[low + 1 : top + 1] > used[low + 1 : top + 1])
                    if not len(free):
                        break
                    chosen.append(low + 1 + int(free[-1]))
                    room -= chosen[-1]
                if len(chosen) < len(pats[j]):
                    break
                times = min([k, *(int(left[x]) // chosen.count(x) for x in set(chosen))])
                for x in chosen:
                    left[x] -= times
                groups.append([chosen, times])
                k -= times
    # Best-fit decreasing of the rest; open sequences are kept by their room.
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(group: list) -> None:
        room = size - sum(group[0])
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(group)

    for g in groups:
        put(g)
    for length in range(size, 0, -1):
        c = int(left[length])
        while c > 0:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                if c >= each:
                    put([[length] * each, c // each])
                if c % each:
                    put([[length] * (c % each), 1])
                break
            room = rooms[at]
            group = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            times = min(c, group[1])
            if group[1] > times:
                put([group[0], group[1] - times])
            put([[*group[0], length], times])
            c -= times
    done = [(g, k) for gs in by_room.values() for g, k in gs]
    return done, sum(k for _, k in done)


def slots(groups: list[tuple[list[int], int]], size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Sorted keys (length and first rank), and each slot's first sequence and offset."""
    used = [0] * (size + 1)
    rows, sequence = [], 0
    for lengths, copies in groups:
        offset = 0
        for x in lengths:
            rows.append(((x << 48) + used[x], sequence, offset))
            used[x] += copies
            offset += x
        sequence += copies
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces (a table that can be read again).

    A column _salt, written with the table, tells repeated rows apart, so that they are dealt out too.
    """
    hist = np.zeros(size + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        hist[length] = n
    groups, _ = plan(hist, size)
    keys, firsts, offsets = slots(groups, size)
    n_buckets = max(64, int(hist.sum()) // 50_000)
    salt = ", _salt" if "_salt" in cut.columns else ""
    cut = cut.withColumn("_bucket", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32{salt}), {n_buckets}) as int)"))
    before = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = before.selectExpr("length", "_bucket", "coalesce(sum(_n) over (partition by length order by _bucket rows between unbounded preceding and 1 preceding), 0) as _before")
    ranked = cut.selectExpr("*", "row_number() over (partition by length, _bucket order by doc_id, piece) - 1 as _row")
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_key", F.expr("shiftleft(length, 48) + _before + _row"))

    def place(key: pd.Series) -> pd.DataFrame:
        k = key.to_numpy()
        at = np.searchsorted(keys, k, side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + (k - keys[at]), "offset": offsets[at]})

    placed = F.pandas_udf(place, T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return ranked.withColumn("_at", placed("_key")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(written(pieces(docs, tokenizer).withColumn("_salt", F.monotonically_increasing_id())))
