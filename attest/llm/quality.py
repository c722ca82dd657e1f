"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The base rules count words, symbols, repeated lines and repeated eight-word windows of each whole text.  The verdict
is the mean over a text's words and word pairs of log p_target / p_raw, where both multinomials are over ``buckets``
hash buckets: the raw one counts every document, the target one the trusted documents.  A document is kept if the
base rules pass and the mean is at least ``threshold``; nothing is drawn at random.

All texts are read twice and no text is shuffled: counts are added up by bucket, so their table has a fixed size, and
that is what the second reading gets.  The trusted rows are a sample of at most ``trusted_rows`` rows of quality 1
(those of least hash), which is broadcast; counts of the raw corpus have no bound.

Cases: a null or empty text has no words and fails the base rules; repeated rows give repeated result rows; a null
doc_id is judged like any other but never trusted; without labels the ratio is zero everywhere, so the base rules
decide; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
#: In nats per n-gram.  Prose like the trusted rows scores a little above zero, lists, symbols and shouting well below.  Set
#: between the labels' two classes: of 3,302 labelled rows of quality 1 that pass the base rules the least has -0.057, and 97%
#: of 301 of quality 0 lie below -0.08, half of them below -1.2 (10,000 documents).
THRESHOLD = -0.08


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body's lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated(h: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text holds twice or more, from the words' hashes."""

    def windows(h: Column) -> Column:
        first = F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1))
        return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(s: Column) -> Column:
        # s: (hash, position) in order, so equal windows are neighbours.
        same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)))
        at = F.array_sort(F.transform(same, lambda x: x["i"]))
        # Each window adds the words after the last one's end.
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, i - 1), F.lit(-WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def of(w: Column) -> Column:
        marked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(marked, covered))

    return let(h, lambda h: F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows(h), of)))


def base(text: Column, words: Column, h: Column) -> list[Column]:
    """The base rules' columns."""
    text = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeated(h).alias("n_repeat_words"),
    ]


def grams(h: Column, buckets: int) -> Column:
    """The buckets of a text's words and word pairs, from the words' hashes."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """log p_target / p_raw of each bucket, both smoothed by one count."""
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = written(trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)).withColumn("_trusted", F.lit(1))
    marked = docs.select("doc_id", hashes_of(words_of(F.col("text"))).alias("h")).join(F.broadcast(trusted), "doc_id", "left")
    counts = marked.select("_trusted", F.explode(let(F.col("h"), lambda h: grams(h, buckets))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target"))
    raw, target = [1] * buckets, [1] * buckets
    for b, r, t in counts.collect():  # at most one row a bucket
        raw[b] += r
        target[b] += t
    if sum(target) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def score(h: Column, weight: list[float]) -> Column:
    """The mean weight of a text's n-grams; zero without any."""
    # One literal, folded from text: an array of so many literals takes seconds to plan.
    w = F.split(F.lit(",".join(map(repr, weight))), ",").cast("array<double>")
    sums = let(h, lambda h: F.aggregate(grams(h, len(weight)), F.lit(0.0), lambda a, b: a + F.get(w, b)))
    return F.round(sums / F.greatest(2 * F.size(h) - 1, F.lit(1)), 9)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and the score of every row."""
    weight = weights(docs, labels, buckets, trusted_rows)
    split = docs.select("doc_id", "text", words_of(F.col("text")).alias("words")).withColumn("h", hashes_of(F.col("words")))
    rows = split.select("doc_id", *base(F.col("text"), F.col("words"), F.col("h")), score(F.col("h"), weight).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


query = judged
