"""Secret scans: fixed patterns, and a small character network for what they miss.

The base patterns (assignments, access keys, hexadecimal runs) always hold.  Every other candidate, a run of 12 key
characters or more, is judged by a convolutional network over its characters and its
surroundings, a long one in overlapping views, of which the likeliest counts.  Where an access key or a hexadecimal run
is part of a run, the whole run is judged and the rest of it found; what stands before an assignment is judged alone.
The network is trained in numpy on labelled findings: the base patterns' values are the positives and other runs the
negatives, but for those that look like keys, which may be secrets that the patterns miss; from at most ``TRAIN_DOCS`` texts, ``POSITIVES`` and ``NEGATIVES`` views (those of least hash).  Each is
also cut and drawn anew in other alphabets and lengths (``variants``), as keys differ in those; half of the positives get
the surroundings of a negative, so that the network can't lean on the word before the value.  Its output is calibrated
on examples it did not train on, and the threshold is the highest at which ``RECALL`` of those positives are found,
however low that is; the recall and precision on them are kept with the network and logged.  Every row is scanned, over its whole text.

Cases: a null or empty text has no spans; without positives or negatives to learn from there are only base spans;
repeated rows give repeated result rows; a null doc_id is kept; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import logging
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Candidates, and runs that negatives come from.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SHORTEST = 12
#: A run that changes between small letters, capitals and digits at so many of its places looks like a key.
CHANGES = 0.2
_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
_WORDS = ("password", "passwd", "secret", "token", "api")

TRAIN_DOCS = 20_000
#: At most so many positive and negative views.
POSITIVES, NEGATIVES = 2_000, 8_000
RECALL = 0.98
LEFT, BODY, RIGHT = 24, 40, 16
MARK = chr(1)

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """(start, index of kind, end) of the base patterns, in order."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 hexadecimal digits lies in a long run.
    for run in LONG.finditer(text):
        if run.end() - run.start() >= 24:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(found)


def _free(spans: list[Span], start: int, end: int) -> bool:
    return not any(s < end and start < e for s, _, e in spans)


def _rest(spans: list[Span], start: int, end: int) -> list[tuple[int, int]]:
    """What the spans leave of start:end."""
    out = []
    for s, _, e in spans:
        if s < end and start < e:
            if start < s:
                out.append((start, s))
            start = e
    return [*out, (start, end)] if start < end else out


def _mixed(body: str) -> bool:
    return bool(re.search(r"[0-9]", body) and re.search(r"[A-Za-z]", body))


def keylike(body: str) -> bool:
    """Letters and digits that change their kind as often as random ones do."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "" for c in body]
    return _mixed(body) and sum(bool(a and b) and a != b for a, b in zip(kinds, kinds[1:])) >= CHANGES * (len(body) - 1)


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts that no base span covers) of all runs.

    An assignment's name is no part of a key, so it cuts its run; an access key or hexadecimal run is a part of it.
    """
    out, first = [], 0
    for m in RUN.finditer(text):
        while first < len(spans) and spans[first][2] <= m.start():
            first += 1
        near = []
        for x in itertools.islice(spans, first, None):
            if x[0] >= m.end():
                break
            near.append(x)
        for start, end in _rest([x for x in near if x[1] == 0], m.start(), m.end()):
            if end - start >= SHORTEST and (parts := _rest(near, start, end)):
                out.append((start, end, parts))
    return out


def view(text: str, start: int, end: int, at: int | None = None) -> str:
    """What the network sees: some context, the candidate (BODY of it, from ``at``) between marks, some context."""
    at = start if at is None else at
    body = text[at : min(end, at + BODY)]
    return text[max(0, start - LEFT) : start].rjust(LEFT) + MARK + body.ljust(BODY, chr(0)) + MARK + text[end : end + RIGHT].ljust(RIGHT)


def views(text: str, start: int, end: int) -> list[str]:
    """Views that overlap by half and cover the whole candidate."""
    last = max(start, end - BODY)
    return [view(text, start, end, at) for at in (*range(start, last, BODY // 2), last)]


def variants(value: str) -> list[str]:
    """A finding's value as keys of other lengths and alphabets look, the same for the same value."""
    r = random.Random(value)
    n = r.randint(min(SHORTEST, len(value)), len(value))
    at = r.randint(0, len(value) - n)
    drawn = ["".join(r.choice(letters) for _ in range(r.randint(SHORTEST, BODY))) for letters in _ALPHABETS]
    return [x for x in (value[at : at + n], value.swapcase(), *drawn) if x != value and _mixed(x)]


def examples(text: str | None) -> list[tuple[int, str]]:
    """(label, view) of a text's labelled findings, as they are and varied, and of its other runs."""
    if not text:
        return []
    spans, out = base_spans(text), []
    for start, kind, end in spans:
        if kind == 0:
            m = ASSIGN.match(text, start, end)
            start, end = m.span(2) if m else (start, end)
        out += [(1, v) for v in views(text, start, end)]
        for value in variants(text[start:end]):
            around = text[max(0, start - LEFT) : start] + value + text[end : end + RIGHT]
            out += [(1, v) for v in views(around, min(start, LEFT), min(start, LEFT) + len(value))]
    for m in RUN.finditer(text):
        if not keylike(m[0]) and _free(spans, m.start(), m.end()):
            out += [(0, v) for v in views(text, m.start(), m.end())]
    return out


class Network:
    """Embedding, one convolution of five characters, maximum over places, one hidden layer, a calibrated logit."""

    WIDTH = LEFT + BODY + RIGHT + 2
    EMBED, K, FILTERS, HIDDEN = 8, 5, 24, 16

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = self.EMBED + 1
        self.p = {
            "e": r.normal(0, 0.3, (128, self.EMBED)),
            "w1": r.normal(0, (2 / (d * self.K)) ** 0.5, (d * self.K, self.FILTERS)),
            "b1": np.zeros(self.FILTERS),
            "w2": r.normal(0, (2 / self.FILTERS) ** 0.5, (self.FILTERS, self.HIDDEN)),
            "b2": np.zeros(self.HIDDEN),
            "w3": r.normal(0, 0.3, (self.HIDDEN, 1)),
            "b3": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1
        #: On held-out examples, at the threshold.
        self.recall = self.precision = float("nan")

    def codes(self, views: list[str]) -> np.ndarray:
        return np.array([[min(ord(c), 127) for c in v] for v in views], np.int64).reshape(-1, self.WIDTH)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        inside = np.zeros(self.WIDTH)
        inside[LEFT : LEFT + BODY + 2] = 1
        v = np.concatenate((p["e"][x], np.broadcast_to(inside[None, :, None], (*x.shape, 1))), axis=2)
        n = self.WIDTH - self.K + 1
        cols = np.concatenate([v[:, k : k + n] for k in range(self.K)], axis=2)
        z = cols @ p["w1"] + p["b1"]
        at = z.argmax(1)
        top = np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0], 0)
        h = np.maximum(top @ p["w2"] + p["b2"], 0)
        return (h @ p["w3"] + p["b3"])[:, 0], (x, cols, at, top, h)

    def _gradients(self, kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, cols, at, top, h) = self.p, kept
        g = {"w3": h.T @ d[:, None], "b3": d.sum(keepdims=True)}
        dh = d[:, None] * p["w3"][:, 0] * (h > 0)
        g |= {"w2": top.T @ dh, "b2": dh.sum(0)}
        dz = (dh @ p["w2"].T) * (top > 0)
        # Only the place of a filter's maximum gets its gradient.
        won = np.take_along_axis(cols, at[:, :, None], 1)
        g |= {"w1": np.einsum("nfc,nf->cf", won, dz), "b1": dz.sum(0), "e": np.zeros_like(p["e"])}
        dwon = dz[:, :, None] * p["w1"].T[None]
        for k in range(self.K):
            part = dwon[:, :, k * (self.EMBED + 1) : k * (self.EMBED + 1) + self.EMBED]
            np.add.at(g["e"], np.take_along_axis(x, at + k, 1), part)
        return g

    def fit(self, views: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3) -> Network:
        """Train on four of five examples, calibrate and set the threshold on the fifth."""
        labels = labels.astype(float)
        r = np.random.default_rng(11)
        x = self.codes(views)
        # Surroundings of the negatives, so that neither a word before the value nor its lack tells them apart.
        lent, plain = np.flatnonzero((labels == 1) & (r.random(len(x)) < 0.5)), np.flatnonzero(labels == 0)
        if len(plain):
            from_ = r.choice(plain, len(lent))
            x[lent, :LEFT], x[lent, -RIGHT:] = x[from_, :LEFT], x[from_, -RIGHT:]
        test = np.arange(len(x)) % 5 == 4
        if not (labels[test] == 1).any() or labels[~test].min(initial=1) == labels[~test].max(initial=0):
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rows, step = np.flatnonzero(~test), 0
        for _ in range(epochs):
            r.shuffle(rows)
            for at in range(0, len(rows), batch):
                b = rows[at : at + batch]
                logit, kept = self._forward(x[b])
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[b]) / len(b)
                step += 1
                for k, g in self._gradients(kept, d).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        logit, y = self._forward(x[test])[0], labels[test]
        for _ in range(200):  # a slope and an offset, lightly held towards one and zero
            q = 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))
            self.scale -= 0.05 * (((q - y) * logit).mean() + 0.01 * (self.scale - 1))
            self.shift -= 0.05 * ((q - y).mean() + 0.01 * self.shift)
        p = self.predict_codes(x[test])
        hits = np.sort(p[y == 1])
        self.threshold = float(hits[int((1 - RECALL) * len(hits))])
        self.recall, self.precision = float((hits >= self.threshold).mean()), float(y[p >= self.threshold].mean())
        logging.getLogger(__name__).info("held-out recall %.4f, precision %.4f at threshold %.4f", self.recall, self.precision, self.threshold)
        return self

    def predict_codes(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        logit = np.concatenate([self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def predict(self, views: list[str]) -> np.ndarray:
        return self.predict_codes(self.codes(views)) if views else np.zeros(0)


def train(docs: DataFrame) -> Network:
    """Fit on the examples of a bounded sample of texts, by least hash."""
    small_batches(docs.sparkSession)
    source = docs.filter("text is not null").select("text", F.xxhash64("doc_id", "text").alias("_h"))
    n = source.count()
    if n > TRAIN_DOCS:
        source = source.filter(F.col("_h") < F.lit(int(-(2**63) + 2**64 * TRAIN_DOCS / n)))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([e for t in pdf["text"] for e in examples(t)], columns=["label", "view"]).astype({"label": "int32"})

    found = source.mapInPandas(of, "label int, view string")
    rows = []
    for label, most in enumerate((NEGATIVES, POSITIVES)):
        rows += found.filter(F.col("label") == label).distinct().orderBy(F.xxhash64("view"), "view").limit(most).collect()
    rows.sort(key=lambda r: hashlib.md5(r.view.encode("utf-8", "surrogatepass")).digest())
    return Network().fit([r.view for r in rows], np.array([r.label for r in rows]))


def scan(texts: list[str | None], network: Network) -> list[tuple[list[Span], list[Span]]]:
    """Each text's base spans, and all spans."""
    base = [base_spans(t) if t else [] for t in texts]
    every = [list(b) for b in base]
    seen: list[str] = []
    owner: list[int] = []
    best: list[float] = []
    parts: list[tuple[int, list[tuple[int, int]]]] = []

    def judge() -> None:
        for o, q in zip(owner, network.predict(seen).tolist()):
            best[o] = max(best[o], q)
        seen.clear()
        owner.clear()

    for i, t in enumerate(texts):
        for s, e, rest in candidates(t, base[i]) if t else ():
            parts.append((i, rest))
            best.append(0.0)
            for v in views(t, s, e):
                seen.append(v)
                owner.append(len(parts) - 1)
                if len(seen) == 2048:
                    judge()
    judge()
    for (i, rest), q in zip(parts, best):
        if q >= network.threshold:
            every[i] += [(s, 3, e) for s, e in rest]
    return [(b, sorted(a)) for b, a in zip(base, every)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind of its first."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def scanned(text: Column, network: Network) -> Column:
    """A struct of the counts, digests, spans and the redacted text."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(network)  # a few kB

    def of(texts: pd.Series) -> pd.DataFrame:
        rows = texts.tolist()
        out = []
        for t, (b, a) in zip(rows, scan(rows, held.value)):
            n = [sum(k == i for _, k, _ in b) for i in range(3)]
            out.append((*n, hashlib.sha256(joined(b).encode()).hexdigest(), joined(a), redacted(t, a)))
        release()
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return F.pandas_udf(of, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")(text)


def query(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", scanned(F.col("text"), train(docs)).alias("_at"))
    return found.select("doc_id", *[f"_at.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])
