"""SentencePiece encoding and decoding by suffix-array matching.

Merging never joins two characters that stand side by side in no piece, so texts are cut there into units, and only a
batch's different units are encoded.  They are put end to end and indexed by a suffix array.  Every piece of the
vocabulary is looked up by two binary searches, all pieces at once, which gives the range of its occurrences; those are
the edges of all units' lattices.  Edges are sorted by where they end and relaxed in that order.  The model merges
pairs by priority, so the right path is the one whose neighbours are all compatible: a piece may follow another if
merging their joined text gives just those two.  The last piece of every prefix is unique, so one pass finds it.
Characters outside the vocabulary become byte pieces.

Ids equal those of the sentencepiece library.  Decoding gives back the text, except that a text's own space marks
(U+2581) become spaces.  Units are told apart by 64-bit hashes; ``exact`` compares every decoded row with its text.

Cases: a null or empty text has no ids; repeated rows give repeated result rows; a null doc_id is kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans

MARK = "▁"
#: UTF-8 bytes of text that are encoded together, characters of units indexed together, and units remembered.
TOGETHER, INDEXED, CACHE = 4 << 20, 1 << 20, 1_000_000
_END = 0x110000
_BASE = 0x9E3779B97F4A7C15


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Coder:
    """One vocabulary.  Its merging pieces are numbered by priority: single characters, then merges, best first."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.id = {p: i for i, p in enumerate(pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        bytes_of = {i: bytes([b]) for b, i in self.byte.items()}
        #: What each id decodes to.
        output = [bytes_of.get(i, b"" if i in special else p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        self.out_size = np.array([len(b) for b in output], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_flat = np.frombuffer(b"".join(output), np.uint8)
        self._number()
        self._forget()

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The model's own rule, merge the neighbours whose union scores best, leftmost first: the parts that are left,
        and the last two that were merged."""
        parts, last, score = list(text), (text, text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _number(self) -> None:
        """Tables of the pieces that merging can make."""
        last = {p: two for p in self.id for parts, two in [self._merge(p)] if parts == [p]}
        usable = sorted(last, key=lambda p: (len(p) > 1, -self.score[p], p))
        number = {p: i for i, p in enumerate(usable)}
        inside = sorted({c for p in usable if len(p) > 1 for c in p})
        if any(c not in number for c in inside):
            raise ValueError("a piece holds a character that is no piece")
        self.usable = usable
        self.ids = np.array([self.id[p] for p in usable], np.int64)
        self.size_of = np.array([len(p) for p in usable], np.int64)
        self.longest = int(self.size_of.max())
        self.wide = np.zeros((len(usable), self.longest), np.int64)
        for i, p in enumerate(usable):
            self.wide[i, : len(p)] = [ord(c) for c in p]
        #: The last merge of each piece; a single character is its own.
        self.left = np.array([number[last[p][0]] for p in usable], np.int64)
        self.right = np.array([number[last[p][1]] for p in usable], np.int64)
        made = sorted((number[p[:i]] * len(usable) + number[p[i:]], number[p]) for p in usable for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.made_key, self.made = (np.array([m[k] for m in made], np.int64) for k in (0, 1))
        #: Which characters stand side by side in a piece.
        self.kind = np.zeros(_END, np.int16)
        for k, c in enumerate(inside, 1):
            self.kind[ord(c)] = k
        self.beside = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for p in usable:
            at = self.kind[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True

    def _forget(self) -> None:
        """Units known so far: sorted hashes, and where each one's ids are."""
        self.keys = np.zeros(0, np.uint64)
        self.first = self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two pieces gives just those two.

        Merges are undone, latest first, along the right edge of a and the left edge of b; at each step the pieces that
        then met must not have merged before the undone merge was made.
        """
        ok = np.ones(len(a), bool)
        open_, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), len(self.usable) + 1, np.int64)
        while len(open_):
            key = a * len(self.usable) + b
            at = np.minimum(np.searchsorted(self.made_key, key), len(self.made_key) - 1)
            met = (self.made_key[at] == key) & (self.made[at] < limit)
            ok[open_[met]] = False
            open_, a, b = open_[~met], a[~met], b[~met]
            # The later one is undone; of two equal ones the right, for the left was made first.
            undo_a = a > b
            next_a, next_b = self.right[a], self.left[b]
            undo_a = np.where(undo_a, next_a != a, next_b == b)
            done = (next_a == a) & (next_b == b)
            limit = np.where(undo_a, a, b + 1)[~done]
            a, b = np.where(undo_a, next_a, a)[~done], np.where(undo_a, b, next_b)[~done]
            open_ = open_[~done]
        return ok

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Positions in order of what follows them, as far as the longest piece reaches."""
        n = len(text)
        padded = np.concatenate((text, np.zeros(2, np.int64)))
        key, reach = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2:], 3
        while True:
            order = np.argsort(key, kind="stable")
            if reach >= self.longest:
                return order
            rank = np.empty(n + reach, np.int64)
            rank[n:] = 0
            rank[order] = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            key, reach = rank[:n] * (n + 1) + rank[reach:], 2 * reach

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of all occurrences of all pieces, none of which crosses a unit's end."""
        order = self._suffixes(text)
        padded = np.concatenate((text, np.full(self.longest, -1, np.int64)))

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.usable), np.int64), np.full(len(self.usable), len(text), np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                at = order[mid]
                sign = np.zeros(len(open_), np.int64)
                for j in range(self.longest):
                    left = (sign == 0) & (self.size_of[open_] > j)
                    if not left.any():
                        break
                    sign[left] = np.sign(padded[at[left] + j] - self.wide[open_[left], j])
                right = (sign < 0) | ((sign == 0) & after)
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]
            return low

        first = bound(False)
        count = bound(True) - first
        return order[_ranges(first, count)], np.repeat(np.arange(len(self.usable)), count)

    def _encode_units(self, units: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units (characters end to end, and sizes), end to end, and how many each has."""
        text = np.full(len(units) + len(size), _END, np.int64)
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        text[_ranges(starts, size)] = units
        at, piece = self._edges(text)
        # Characters that no piece is.
        single = np.zeros(len(text), bool)
        single[at[self.size_of[piece] == 1]] = True
        single[ends] = True
        unknown, lone = np.flatnonzero(~single), len(self.usable)
        at, piece = np.concatenate((at, unknown)), np.concatenate((piece, np.full(len(unknown), lone)))
        length = np.append(self.size_of, 1)
        end = at + length[piece]
        turn = end - np.repeat(starts, size + 1)[at]
        order = np.argsort(turn, kind="stable")
        at, piece, end, turn = at[order], piece[order], end[order], turn[order]
        is_start = np.zeros(len(text) + 1, bool)
        is_start[starts] = True
        last = np.full(len(text) + 1, -1, np.int64)
        cut = np.flatnonzero(np.diff(turn)) + 1
        for s, e in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(turn)])).tolist()):
            if s == e:
                continue
            a, p = at[s:e], piece[s:e]
            before = last[a]
            ok = is_start[a] | ((before >= 0) & ((before == lone) | (p == lone)))
            ask = np.flatnonzero(~ok & (before >= 0))
            if len(ask):
                ok[ask] = self._compatible(before[ask], p[ask])
            last[end[s:e][ok]] = p[ok]
        # Walk back from all units' ends at once.
        here, alive = ends.copy(), np.flatnonzero(size > 0)
        rows, codes, steps = [], [], []
        while len(alive):
            p = last[here[alive]]
            if (p < 0).any():
                raise RuntimeError("a unit has no path through its pieces")
            here[alive] -= length[p]
            rows.append(alive)
            codes.append(np.where(p == lone, -1 - text[here[alive]], self.ids[np.minimum(p, lone - 1)]))
            steps.append(np.full(len(alive), len(steps)))
            alive = alive[here[alive] > starts[alive]]
        row, code, step = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, codes, steps))
        order = np.lexsort((-step, row))
        row, code = row[order], code[order]
        wide = np.ones(len(code), np.int64)
        foreign, which = np.unique(-1 - code[code < 0], return_inverse=True)
        spelled = [[self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in foreign.tolist()]
        wide[code < 0] = np.array([len(x) for x in spelled], np.int64)[which]
        out = np.repeat(np.maximum(code, 0), wide)
        if len(foreign):
            places = (np.cumsum(wide) - wide)[code < 0]
            flat, begin = np.array([b for x in spelled for b in x], np.int64), np.cumsum([0, *map(len, spelled)])[which]
            out[_ranges(places, wide[code < 0])] = flat[_ranges(begin, wide[code < 0])]
        return out.astype(np.uint32), np.bincount(row, weights=wide, minlength=len(size)).astype(np.int64)

    def _places(self, keys: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where each of some different units is among the known ones, which it joins if it is new."""
        if len(self.keys) + len(keys) > CACHE:
            self._forget()
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
        if new.any():
            s, n = start[new], size[new]
            part = np.cumsum(n) // INDEXED
            found = [self._encode_units(text[_ranges(s[part == k], n[part == k])].astype(np.int64), n[part == k]) for k in np.unique(part)]
            count = np.concatenate([c for _, c in found])
            first = np.cumsum(count) - count + len(self.flat)
            self.flat = np.concatenate((self.flat, *[f for f, _ in found]))
            every = np.concatenate((self.keys, keys[new]))
            order = np.argsort(every, kind="stable")
            self.keys = every[order]
            self.first, self.count = np.concatenate((self.first, first))[order], np.concatenate((self.count, count))[order]
        return np.searchsorted(self.keys, keys)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and where each text's begin and end."""
        rows = [MARK + t.replace(" ", MARK) if t else "" for t in texts.to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        text = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(text):
            return np.zeros(0, np.uint32), np.zeros(len(rows) + 1, np.int64)
        kind = self.kind[text]
        new = np.ones(len(text), bool)
        new[1:] = ~self.beside[kind[:-1], kind[1:]]
        new[bounds[bounds < len(text)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(text))
        keys, first, which = np.unique(spans(text.astype(np.uint64) + np.uint64(1), starts, ends, _BASE), return_index=True, return_inverse=True)
        at = self._places(keys, text, starts[first], (ends - starts)[first])[which]
        each = self.count[at]
        upto = np.concatenate(([0], np.cumsum(each)))
        return self.flat[_ranges(self.first[at], each)], upto[np.searchsorted(starts, bounds)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of some ids, without the space mark that encoding puts in front."""
        size = self.out_size[ids]
        out = self.out_flat[_ranges(self.out_start[ids], size)].tobytes()
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The worker's own coder, kept from task to task."""
    return Coder(path)


def encoded(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids), exact (whether decoding gives the text) and,
    if asked for, the ids of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                rows = batch.slice(first, last - first)
                ids, offsets = own.encode(rows.column("text"))
                parts = [ids[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                exact = [own.decode_bytes(p) == (t or "").encode("utf-8", "surrogatepass") for p, t in zip(parts, rows.column("text").to_pylist())]
                arrays = [rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array([zlib.crc32(p.astype("<u4")) for p in parts], pa.int64()), pa.array(exact, pa.bool_())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_ids", "ids_crc32", "exact", "ids"][: len(arrays)])

    schema = "doc_id long, n_ids long, ids_crc32 long, exact boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, schema)


def decoded(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; bytes that are no UTF-8 become U+FFFD."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [coder(model).decode_bytes(np.array(x, np.int64)).decode("utf-8", "replace") if x is not None else None for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(of, "doc_id long, text string")


def query(docs: DataFrame, model: str) -> DataFrame:
    return encoded(docs, model, with_ids=True)
