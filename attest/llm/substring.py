"""Substring dedup by relative Lempel-Ziv parsing: which windows of words the corpus holds twice.

A window is ``WINDOW`` consecutive words of one document; its anchor is the least hash among its ``GRAM``-word sequences.
Consecutive windows with one anchor make a phrase.  Equal windows have equal anchors, so a window's copies can only be
in phrases of its anchor, and reference blocks are made of phrases that share anchors.  A document then meets just
those reference blocks that can hold a copy of its windows, whatever the number of blocks:

1. documents are dealt into blocks of a few MB, and each block's anchors are counted; those found twice or more anywhere
   go back to their blocks, and an anchor found once rules out all its windows;
2. each block lists the words of its phrases with such anchors, each different phrase once;
3. phrases are dealt by anchor into reference blocks, which are indexed by a suffix array over their words.  Each phrase
   is factored greedily: the longest sequence from here that also starts anywhere else in the block is a factor, and
   the next one begins behind it.  All windows in a factor of WINDOW words or more are duplicates.  A duplicate window
   that no single factor holds spans just one boundary between two factors that are that long together, since from
   the boundary on the rest of the window occurs elsewhere; so there, and only there, the windows across are looked up;
4. each block joins duplicate windows into maximal stretches and removes the words they cover.

A phrase is sent once by each block, but a passage in ever other surroundings gives ever other phrases.  Where an anchor
has more than ``CROWD`` of them, one reference block would grow with the copies.  Those windows are settled one by
one: counted by their anchor and hash, with sums before the shuffle, so no task gets all phrases of an anchor.

Factors compare words themselves; crowded anchors' windows compare by two 64-bit hashes.  A block's marks find their
phrases by a 64-bit hash of the phrase.

Cases: a null, empty or short text has no window and keeps all its words; repeated rows are copies of each other, so
both lose all words of their windows; a null doc_id is kept; texts may be of any length; an empty table gives an empty
result; other columns are not read by ``removed`` and kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_words, release, spans, written

WINDOW = 35
GRAM = 8
#: UTF-8 bytes of text in a block.
BLOCK = 4 << 20
#: A block of so many times that is dealt anew.
LARGE = 8
#: Texts are hashed together up to about so many bytes.
CHUNK = 1 << 20
#: Phrases of one anchor that a reference block takes.
CROWD = 64
#: Reference blocks for each block of documents; where all anchors recur, neighbouring phrases overlap by most of their words.
SPREAD = 2

#: Odd bases of the hashes of words, of word sequences and of windows.
_B, _C, _D = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def _sliding(a: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values."""
    k = 1
    while 2 * k <= n:
        a = pick(a[:-k], a[k:])
        k *= 2
    return pick(a[: len(a) - (n - k)], a[n - k :]) if n > k else a


class Parsed:
    """Word starts and ends, window hashes and window anchors of some texts, end to end."""

    def __init__(self, texts: list[str | bytes | None], window: int = WINDOW, gram: int = GRAM):
        parts = [byte_words(t) for t in texts]
        self.window = window
        self.joined = [p[0] for p in parts]
        self.n_words = np.array([len(p[1]) for p in parts], np.int64)
        at = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words))).astype(np.int64)
        #: Where each word starts and ends in all texts put together.
        self.starts = starts = np.concatenate([p[1] + s for p, s in zip(parts, at)]) if parts else np.zeros(0, np.int64)
        self.ends = ends = np.concatenate([p[2] + s for p, s in zip(parts, at)]) if parts else np.zeros(0, np.int64)
        self.all = b"".join(self.joined)
        raw = np.frombuffer(self.all, np.uint8).astype(np.uint64) + np.uint64(1)
        word = spans(raw, starts, ends, _B)
        n = len(word)
        #: Text of each window, the window's first word, hash and anchor.
        self.doc = self.start = np.zeros(0, np.int64)
        self.hash = self.anchor = np.zeros(0, np.uint64)
        #: Anchors, once for each place.
        self.places = self.place_doc = self.hash
        if n < window:
            return
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        grams = spans(word, np.arange(n - gram + 1), np.arange(gram, n + 1), _C)
        reach = window - gram + 1
        least = _sliding(grams, reach, np.minimum)
        ok = doc[: n - window + 1] == doc[window - 1 :]
        # A place is an anchor if a window around it has its hash as the least.
        padded = np.concatenate((np.zeros(reach - 1, np.uint64), np.where(ok, least, 0), np.zeros(reach - 1, np.uint64)))
        is_place = _sliding(padded, reach, np.maximum) == grams
        self.places, self.place_doc = grams[is_place], doc[: len(grams)][is_place]
        at = np.flatnonzero(ok)
        self.doc, self.start, self.anchor = doc[at], at, least[at]
        self.hash = spans(word, at, at + window, _D)
        new = np.ones(len(at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        #: Phrases: where each one's windows begin and end, and a hash of them all.
        self.phrase = np.flatnonzero(new)
        self.phrase_end = np.concatenate((self.phrase[1:], [len(at)])).astype(np.int64) if len(at) else self.phrase
        self.phrase_hash = spans(self.hash, self.phrase, self.phrase_end, _C) if len(at) else self.hash

    def words_of(self, phrases: np.ndarray) -> list[bytes]:
        """The words of some phrases, joined by one space."""
        first = self.starts[self.start[self.phrase[phrases]]]
        last = self.ends[self.start[self.phrase_end[phrases] - 1] + self.window - 1]
        return [self.all[s:e] for s, e in zip(first.tolist(), last.tolist())]

    def kept(self, flagged: np.ndarray) -> list[tuple[int, bytes]]:
        """Words removed and the rest, by text, if the flagged windows go."""
        n = int(self.first[-1])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, self.start[flagged], 1)
        np.add.at(edge, self.start[flagged] + self.window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, joined in enumerate(self.joined):
            mine = gone[self.first[i] : self.first[i + 1]]
            if not mine.any():
                out.append((0, joined))
            elif mine.all():
                out.append((len(mine), b""))
            else:
                left = b" ".join([w for w, g in zip(joined.split(b" "), mine.tolist()) if not g])
                out.append((int(mine.sum()), left))
        return out


def _chunks(pdf: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """Rows of about CHUNK characters of text."""
    size = pdf[text].str.len().fillna(0).to_numpy().cumsum()
    for _, rows in pdf.groupby((size // CHUNK).astype(np.int64), sort=False):
        yield rows


def _isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for held in blocks(batches, "text", BLOCK):
        got = []
        for pdf in _chunks(held, "text"):
            p = Parsed(pdf["text"].tolist())
            if len(p.places):
                got.append(np.column_stack((p.places, pdf["block"].to_numpy()[p.place_doc].astype(np.uint64))))
        if got:
            rows = np.concatenate(got)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
            count = np.diff(np.concatenate((first, [len(rows)])))
            release()
            yield pd.DataFrame({"anchor": rows[first, 0].view(np.int64), "block": rows[first, 1].astype(np.int32), "n": np.minimum(count, 2).astype(np.int8)})


_LISTED = "kind string, block int, doc_id long, text string, n_words long, kept_sha256 string, anchor long, phrase long, n tinyint, words binary"


def _listed(**columns) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({c.split()[0]: columns.get(c.split()[0], [None] * n) for c in _LISTED.split(", ")})


def _list_phrases(docs: pd.DataFrame, shared: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    """One block: finished rows, texts that hold a shared anchor, and those texts' different phrases."""
    among = np.unique(shared["anchor"].to_numpy().astype(np.int64).view(np.uint64))
    out, anchors, phrases, listed = [], [], [], []
    for pdf in _chunks(docs, "text"):
        p = Parsed(pdf["text"].tolist())
        open_docs = np.zeros(len(pdf), bool)
        if len(p.start):
            hit = np.flatnonzero(_isin(p.anchor[p.phrase], among))
            open_docs[p.doc[p.phrase[hit]]] = True
            anchors.append(p.anchor[p.phrase[hit]])
            phrases.append(p.phrase_hash[hit])
            listed += p.words_of(hit)
        ids = pdf["doc_id"].tolist()
        done, rest = np.flatnonzero(~open_docs), np.flatnonzero(open_docs)
        if len(done):
            texts = [pdf["text"].iloc[i] for i in done] if with_text else [None] * len(done)
            out.append(_listed(kind=["done"] * len(done), doc_id=[ids[i] for i in done], text=texts, n_words=p.n_words[done], kept_sha256=[hashlib.sha256(p.joined[i]).hexdigest() for i in done]))
        if len(rest):
            out.append(_listed(kind=["open"] * len(rest), block=[int(pdf["block"].iloc[0])] * len(rest), doc_id=[ids[i] for i in rest], text=[pdf["text"].iloc[i] if with_text else p.joined[i].decode("utf-8", "surrogatepass") for i in rest]))
    if listed:
        phrase, first, count = np.unique(np.concatenate(phrases), return_index=True, return_counts=True)
        anchor = np.concatenate(anchors)[first]
        out.append(_listed(kind=["phrase"] * len(phrase), block=[int(docs["block"].iloc[0])] * len(phrase), anchor=anchor.view(np.int64), phrase=phrase.view(np.int64), n=np.minimum(count, 2), words=[listed[i] for i in first.tolist()]))
    release()
    return pd.concat(out, ignore_index=True) if out else _listed(kind=[])


class Reference:
    """A suffix array over the words of some phrases, by prefix doubling."""

    #: Matches are told apart up to REACH words, longer ones are cut there.
    STEPS = (1, 2, 4, 8, 16, 32)
    REACH = sum(STEPS)

    def __init__(self, phrases: list[bytes]):
        words = [w for p in phrases for w in p.split(b" ")]
        codes, different = pd.factorize(np.array(words, object))
        sizes = np.array([p.count(b" ") + 1 for p in phrases], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        n = len(words) + len(phrases)
        # A phrase is followed by a sign of its own, so no match goes beyond its end.
        text = np.zeros(n, np.int64)
        solid = np.ones(n, bool)
        solid[self.ends] = False
        text[solid] = codes
        text[self.ends] = len(different) + np.arange(len(phrases))
        self.ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        for step in self.STEPS:
            self.ranks.append(np.unique(self._pairs(self.ranks[-1], step), return_inverse=True)[1])
        last = self.ranks.pop()
        self.order = np.argsort(last, kind="stable")

    @staticmethod
    def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
        """Each place's rank and that of the place ``step`` words on; places behind the end come first."""
        then = np.zeros(len(rank), np.int64)
        then[:-step] = rank[step:] + 1
        return rank * (len(rank) + 1) + then

    def longest(self) -> np.ndarray:
        """For each place, the length of the longest sequence of words from there that starts at another place too."""
        a, b = self.order[:-1], self.order[1:]
        n = len(self.order)
        common = np.zeros(len(a), np.int64)
        for step, rank in zip(reversed(self.STEPS), reversed(self.ranks)):
            x, y = a + common, b + common
            both = (x < n) & (y < n)
            common += step * (both & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
        found = np.zeros(n, np.int64)
        found[a] = common
        found[b] = np.maximum(found[b], common)
        return found


def factors(reference: Reference, longest: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy factors of some phrases of a block: which phrase, where each starts, and where it ends."""
    got = []
    at, ends = reference.starts[which], reference.ends[which]
    while len(which):
        end = at + np.maximum(longest[at], 1)
        got.append((which, at, end))
        going = end < ends
        which, at, ends = which[going], end[going], ends[going]
    if not got:
        return (np.zeros(0, np.int64),) * 3
    phrase, start, end = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((start, phrase))
    return phrase[order], start[order], end[order]


def duplicates(phrases: list[bytes], copies: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each of some different phrases, which of its windows start at another place of the block or of its copies."""
    reference = Reference(phrases)
    longest = reference.longest()
    flags = np.zeros(len(longest) + 1, np.int64)  # steps up and down
    same = np.flatnonzero(copies > 1)
    np.add.at(flags, reference.starts[same], 1)
    np.add.at(flags, reference.ends[same] - window + 1, -1)
    phrase, start, end = factors(reference, longest, np.flatnonzero(copies == 1))
    long = end - start >= window
    np.add.at(flags, start[long], 1)
    np.add.at(flags, end[long] - window + 1, -1)
    flagged = np.cumsum(flags[:-1]) > 0
    # Boundaries of two factors that hold a window together.
    left = np.flatnonzero((phrase[1:] == phrase[:-1]) & (end[1:] - start[:-1] >= window))
    first = np.maximum(start[left], end[left] - window + 1)
    many = np.minimum(end[left], end[left + 1] - window + 1) - first
    some = many > 0
    first, many = first[some], many[some]
    across = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    flagged[across[longest[across] >= window]] = True
    return [flagged[s : e - window + 1] for s, e in zip(reference.starts.tolist(), reference.ends.tolist())]


_MARKS = "block int, phrase long, bits binary"


def _marks(blocks_of: np.ndarray, phrases: np.ndarray, flags: list[np.ndarray]) -> pd.DataFrame:
    """Marks of phrases that have any; one that is marked throughout needs no bits."""
    at = [i for i, f in enumerate(flags) if f.any()]
    bits = [b"" if flags[i].all() else np.packbits(flags[i]).tobytes() for i in at]
    return pd.DataFrame({"block": blocks_of[at].astype(np.int32), "phrase": phrases[at].astype(np.int64), "bits": bits})


def _parse(pdf: pd.DataFrame) -> pd.DataFrame:
    """One reference block: every phrase factored against all."""
    code, different = pd.factorize(pdf["words"])
    copies = np.bincount(code, weights=pdf["n"].to_numpy().astype(np.int64)).astype(np.int64)
    flags = duplicates(list(different), copies)
    out = _marks(pdf["block"].to_numpy(), pdf["phrase"].to_numpy(), [flags[c] for c in code.tolist()])
    release()
    return out


def _phrase_chunks(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Parsed]]:
    size = pdf["words"].str.len().to_numpy().cumsum() // CHUNK
    for _, rows in pdf.groupby(size, sort=False):
        yield rows, Parsed(rows["words"].tolist())


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different windows of some phrases, with their anchors and blocks."""
    for pdf in batches:
        for rows, p in _phrase_chunks(pdf):
            of = p.doc
            got = pd.DataFrame({"anchor": rows["anchor"].to_numpy()[of], "window": p.hash.view(np.int64), "block": rows["block"].to_numpy()[of], "n": rows["n"].to_numpy()[of].astype(np.int64)})
            got = got.groupby(["anchor", "window", "block"], as_index=False)["n"].sum()
            yield got.assign(n=np.minimum(got["n"], 2).astype(np.int8))


def _settle(phrases: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """One block: the marks of its phrases with crowded anchors."""
    among = np.unique(shared["window"].to_numpy().astype(np.int64).view(np.uint64))
    out = []
    for rows, p in _phrase_chunks(phrases):
        hit = _isin(p.hash, among)
        bounds = np.searchsorted(p.doc, np.arange(len(rows) + 1))
        out.append(_marks(rows["block"].to_numpy(), rows["phrase"].to_numpy(), [hit[s:e] for s, e in zip(bounds[:-1], bounds[1:])]))
    return pd.concat(out, ignore_index=True) if out else _marks(np.zeros(0, np.int32), np.zeros(0, np.int64), [])


def _finish(docs: pd.DataFrame, marks: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    """One block: cover and remove the words of marked windows."""
    of = dict(zip(marks["phrase"].to_numpy().astype(np.int64).view(np.uint64).tolist(), marks["bits"]))
    out = []
    for pdf in _chunks(docs, "text"):
        p = Parsed(pdf["text"].tolist())
        flagged = np.zeros(len(p.start), bool)
        if of and len(p.start):
            for h, s, e in zip(p.phrase_hash.tolist(), p.phrase.tolist(), p.phrase_end.tolist()):
                bits = of.get(h)
                if bits is not None:
                    flagged[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool) if bits else True
        for doc, text, n, (gone, left) in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), p.n_words.tolist(), p.kept(flagged)):
            out.append((doc, n, gone, hashlib.sha256(left).hexdigest(), *((left.decode("utf-8", "surrogatepass") if gone else text,) if with_text else ())))
    got = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])
    got["doc_id"] = got["doc_id"].astype("string")
    release()
    return got


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and the row's block, and the number of blocks.

    A row's block comes from its hash, so that it is the same in every job.  If that makes a block of many times BLOCK, which
    takes very many repeats of one row or one very long text, rows get a number too and are written with it.
    """
    size = F.octet_length("text").cast("long") + 16
    n = max(1, -(-(docs.agg(F.sum(size)).first()[0] or 0) // BLOCK))
    most = docs.select(F.expr(f"pmod(xxhash64(doc_id, text), {n})").alias("block"), size.alias("size")).groupBy("block").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0]
    key = "doc_id, text"
    if (most or 0) > LARGE * BLOCK:
        docs, key = written(docs.withColumn("_salt", F.monotonically_increasing_id())), "doc_id, text, _salt"
    return docs.select("doc_id", "text", F.expr(f"cast(pmod(xxhash64({key}), {n}) as int)").alias("block")), n


def _twice(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that all blocks together hold twice or more, and the blocks that hold them."""
    return rows.join(rows.groupBy(*key).agg(F.sum("n").alias("n")).filter("n >= 2").select(*key), list(key)).select("block", *key)


def _marked(phrases: DataFrame, n_references: int) -> DataFrame:
    """block, phrase and bits of all phrases with duplicate windows."""
    crowded = written(phrases.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD).select("anchor"))
    calm = phrases.join(crowded, "anchor", "left_anti").withColumn("_reference", F.expr(f"cast(pmod(xxhash64(anchor), {n_references}) as int)"))
    marks = calm.groupBy("_reference").applyInPandas(lambda pdf: _parse(pdf), _MARKS)
    if not crowded.head(1):
        return marks
    hot = phrases.join(crowded, "anchor", "left_semi")
    windows = written(hot.select("block", "anchor", "n", "words").mapInPandas(_windows, "anchor long, window long, block int, n tinyint"))
    shared = _twice(windows, "anchor", "window").select("block", "window")
    settled = hot.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(lambda a, b: _settle(a, b), _MARKS)
    return marks.unionByName(settled)


def _removed(rows: DataFrame, n_blocks: int, with_text: bool) -> DataFrame:
    anchors = written(rows.select("text", "block").mapInPandas(_anchors, "anchor long, block int, n tinyint"))
    shared = _twice(anchors, "anchor")
    listed = _LISTED.replace("doc_id long", "doc_id string")

    def listing(docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        return _list_phrases(docs, shared, with_text) if len(docs) else _listed(kind=[])

    def finishing(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        return _finish(docs, marks, with_text)

    found = written(rows.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(listing, listed))
    marks = _marked(found.filter("kind = 'phrase'").select("block", "anchor", "phrase", "n", "words"), SPREAD * n_blocks)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text]
    done = found.filter("kind = 'done'").withColumn("n_removed", F.lit(0).cast("long")).select(columns)
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    rest = found.filter("kind = 'open'").select("block", "doc_id", "text").groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(finishing, schema)
    return done.unionByName(rest)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return _removed(*dealt(rows), False).withColumn("doc_id", F.col("doc_id").cast("long"))


#: So that JSON keeps microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the duplicate windows' words gone from ``text``; a text that loses none stays as it is, another becomes
    its kept words joined by one space.  The other columns go along as JSON, so no join is needed."""
    others = [c for c in docs.columns if c != "text"]
    rows, n = dealt(docs.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]), _JSON).alias("doc_id"), "text"))
    kinds = docs.select(*[F.col(f"`{c}`") for c in others]).schema
    found = _removed(rows, n, True).select(F.from_json("doc_id", kinds, _JSON).alias("_o"), "text")
    return found.select(*[F.col("text") if c == "text" else F.col("_o")[c].alias(c) for c in docs.columns])


query = removed
