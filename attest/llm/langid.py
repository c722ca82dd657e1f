"""Language identification by word-first backoff.

A word that training saw is scored by its per-language log frequency.  A word it did not see is scored by the
longest character n-grams it holds that training saw, from ``MAX_N`` characters down to one, averaged to one word's
worth.  All n-grams of a word count, as in scripts without spaces a run of letters is a sentence or a whole text.  The
sums over a whole text are divided by its words, and the prediction is the largest; its score is the posterior of that
mean, from 0 to 1, made flatter by ``SHARPNESS``.

The classifier is fitted on a sample of at most about ``train_rows`` labelled rows (those of least hash).  Their words are
counted by language on the executors, and all of them and of their n-grams are kept; so the sample bounds the model, which
is sent to every executor.  Every row is predicted, from its whole text only.

Cases: a null text, or one without letters, is ``und`` with score 0; without any row to learn from all texts are
``und``; ties go to the language first in order; a null doc_id counts as the empty text for the fold, so it is held
out; repeated rows give repeated result rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

UND = "und"
TRAIN_ROWS = 6_000
MAX_N = 4
SHARPNESS = 1.0
#: Words whose scores a worker remembers; beyond it, it starts anew.
CACHE = 200_000
#: Words or n-grams that are looked up at once; longer texts and runs of letters are read in pieces.
PIECE = 200_000
FOLD = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) = 0"

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    found = _LETTERS.findall(text.lower()) if text else []
    # Some number signs, such as fractions, pass the pattern and are no letters.
    return found if any(c.isalpha() for w in found for c in w) else []


def _grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _pieces(words: list[str], n: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """All n-grams of whole words and which word each is of, up to PIECE at once, so that memory is bounded."""
    grams: list[str] = []
    owners: list[tuple[int, int]] = []
    for i, word in enumerate(words):
        w = f"<{word}>" if n > 1 else word
        at, end = 0, max(0, len(w) - n + 1)
        while at < end:
            stop = min(end, at + PIECE - len(grams))
            grams += [w[j : j + n] for j in range(at, stop)]
            owners.append((i, stop - at))
            at = stop
            if len(grams) == PIECE:
                yield grams, np.repeat(*np.array(owners).T)
                grams, owners = [], []
    if grams:
        yield grams, np.repeat(*np.array(owners).T)


def _keys(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)


class Table:
    """Rows of log frequencies by 64-bit hashes of their words or n-grams, in order of hash."""

    def __init__(self, names: list[str], rows: np.ndarray):
        keys = _keys(names)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text is, and whether it is there."""
        keys = _keys(texts)
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys


class Model:
    """Per-language log frequencies of words and of character n-grams."""

    def __init__(self, langs: list[str], words: Table, grams: Table):
        self.langs, self.words, self.grams = langs, words, grams
        self._known: dict[str, int] = {}
        self._rows = np.zeros((0, len(langs)))

    def __getstate__(self):
        return (self.langs, self.words, self.grams)

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, or the mean over its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        at, there = self.words.find(words)
        out[there] = self.words.rows[at[there]]
        rest = np.flatnonzero(~there)
        for n in range(MAX_N, 0, -1):
            if not len(rest):
                break
            found = np.zeros(len(rest), np.int64)
            sums = np.zeros((len(rest), len(self.langs)))
            for grams, owner in _pieces([words[i] for i in rest.tolist()], n):
                at, there = self.grams.find(grams)
                found += np.bincount(owner[there], minlength=len(rest))
                np.add.at(sums, owner[there], self.grams.rows[at[there]])
            hit = found > 0
            out[rest[hit]] = sums[hit] / found[hit, None]
            rest = rest[~hit]
        return out

    def _rows_at(self, words: list[str]) -> np.ndarray:
        """Each word's scores, from memory where it has been seen."""
        new = list(set(words).difference(self._known))
        if new and len(self._known) + len(new) > CACHE:
            self._known.clear()
            self._rows = self._rows[:0]
            new = list(set(words))
        if new:
            self._known.update(zip(new, range(len(self._known), len(self._known) + len(new))))
            self._rows = np.concatenate((self._rows, self.score(new)))
        return self._rows[np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its score of each text."""
        n, k = len(texts), len(self.langs)
        sums, count = np.zeros((n, k)), np.zeros(n, np.int64)
        if k:
            for owner, words in _read(texts):
                rows = self._rows_at(words)
                count += np.bincount(owner, minlength=n)
                for j in range(k):
                    sums[:, j] += np.bincount(owner, rows[:, j], minlength=n)
        out = []
        for mean, c in zip(sums / np.maximum(count, 1)[:, None], count.tolist()):
            if not c:
                out.append((UND, 0.0))
                continue
            p = np.exp(SHARPNESS * (mean - mean.max()))
            best = int(mean.argmax())
            out.append((self.langs[best], float(p[best] / p.sum())))
        return out


def _read(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The runs of letters of all texts, PIECE at once, and which text each is of; none of a text without a letter."""
    words: list[str] = []
    owners: list[int] = []
    sizes: list[int] = []
    for i, text in enumerate(texts):
        low = text.lower() if text else ""
        if not any(map(str.isalpha, low)):  # some number signs, such as fractions, pass the pattern
            continue
        runs = iter(_LETTERS.findall(low)) if len(low) < PIECE else (m[0] for m in _LETTERS.finditer(low))
        while some := list(itertools.islice(runs, PIECE - len(words))):
            words += some
            owners.append(i)
            sizes.append(len(some))
            if len(words) == PIECE:
                yield np.repeat(owners, sizes), words
                words, owners, sizes = [], [], []
    if words:
        yield np.repeat(owners, sizes), words


def _log_rows(of: dict[str, Counter], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """All names that any language has, and a row of log frequencies for each."""
    names = sorted(set().union(*of.values()))
    n = np.array([[of[x][w] for x in langs] for w in names], float).reshape(len(names), len(langs))
    size = n.sum(0)
    # Frequencies are smoothed by the common one and taken relative to it, so a language of few rows is not favoured.
    common = n.sum(1, keepdims=True) / max(size.sum(), 1)
    return names, np.log((n + common + 1e-9) / (size + 1.0)) - np.log(common)


def fit(counts: dict[str, Counter]) -> Model:
    """A model of each language's words and how often it has them."""
    langs = sorted(x for x in counts if counts[x])
    if not langs:
        return Model([], Table([], np.zeros((0, 0))), Table([], np.zeros((0, 0))))
    names, rows = [], []
    for n in range(1, MAX_N + 1):
        of: dict[str, Counter] = {}
        for x in langs:
            c: Counter = Counter()
            for w, k in counts[x].items():
                for g in _grams(w, n):
                    c[g] += k
            of[x] = c
        found = _log_rows(of, langs)
        names += found[0]
        rows.append(found[1])
    return Model(langs, Table(*_log_rows(counts, langs)), Table(names, np.concatenate(rows)))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of least hash outside the held-out fold."""
    small_batches(docs.sparkSession)
    source = docs.filter(f"lang is not null and text is not null and not ({FOLD})").select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    n = source.count()
    if n > train_rows:
        # A share by hash, so no text is sorted or moved but those taken.
        limit = int(-(2**63) + 2**64 * train_rows / n)
        source = source.filter(F.col("_h") < F.lit(limit))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(pdf["lang"], pdf["text"]):
                counts[lang].update(letters(text))
            yield pd.DataFrame([(x, w, n) for x, c in counts.items() for w, n in c.items()], columns=["lang", "word", "n"])

    found = source.select("lang", "text").mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in found.toLocalIterator():  # the words of the sample
        counts[r.lang][r.word] = r.n
    return fit(counts)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added to its columns doc_id and text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(held.value.predict(texts.tolist()), columns=["lang_pred", "score"])
        release()
        return out

    return docs.withColumn("_at", F.pandas_udf(of, "lang_pred string, score double")("text"))


def query(docs: DataFrame) -> DataFrame:
    return predicted(docs.select("doc_id", "text"), train(docs)).select("doc_id", F.expr(FOLD).alias("held_out"), "_at.lang_pred", "_at.score")
