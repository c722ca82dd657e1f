"""Approximate nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length one and cut into small subspaces of sixteen centres each.  Centres and codes minimise
h_par |parallel residual|^2 + |orthogonal residual|^2, where the parallel part, along the vector itself, weighs more,
because it is what changes a large inner product.  Centres are fitted on at most ``SAMPLE`` vectors (those of least
hash); every vector is coded and scanned.

Rows are dealt into lists by their nearest coarse centre, and a query looks into the lists of its nearest centres.  How
many that takes is measured on the sample: so many that ``RECALL`` of the sample's own neighbours are in them.  Data in
clusters need few lists; data without any structure need most of them, and then the work is nearly that of all pairs.
The number of centres grows with the rows up to ``CENTRES_MOST``.  A list of more than ``ROWS`` rows is split into blocks,
and so are the queries that look into it, so a list with a third of all rows is no single task; each row is coded once
for each block of queries.

In a block the two halves of a byte of code share one 256-entry table, a block's tables are added up for all its
candidates, and the best of a block are reranked by the cosine of the original vectors in double precision.  Their k-th
best cosine is a bound, and every other row whose table score leaves it a chance to reach that bound
(``Quantiser.least``) is reranked too, so a block loses no neighbour, however many near or scaled copies it holds.  The
best k of all blocks are taken.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
as queries or candidates; of equal vectors the smaller ids come first, and a block looks at k + 1 of them, which is
all that can be returned; repeated rows count once, and of different vectors with one vec_id the nearest; a null vec_id takes no part; with fewer candidates than k all are
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
EVERY = 50
SAMPLE = 6_000
CENTRES = 16
#: The inner product from which errors matter, as a share of the largest.
AIM = 0.2
ROUNDS = 4
#: Rows of a block of queries and of candidates.  A candidate is sent and coded once for each block of queries.
QUERIES, ROWS = 32768, 4096
#: Rows of a list on average, as long as there are no more than CENTRES_MOST lists; queries of the sample that tell how many to look into.
PER_LIST, CENTRES_MOST = 2048, 256
ASKED, RECALL = 400, 0.99
#: One in so many of a block's rows, and at least LEAST, are reranked to find the bound for all others.
KEEP, LEAST = 32, 40


class Quantiser:
    """Centres of subspaces, fitted to weigh parallel residuals more."""

    def __init__(self, x: np.ndarray, rounds: int = ROUNDS, aim: float = AIM, seed: int = 5):
        d = x.shape[1]
        self.spaces = np.array_split(np.arange(d), max(1, -(-d // 2)))
        self.parallel = max(1.0, (d - 1) * aim * aim / (1 - aim * aim))
        r = np.random.default_rng(seed)
        self.centres = [x[r.integers(0, len(x), CENTRES)][:, s].copy() for s in self.spaces]
        for i, s in enumerate(self.spaces):  # plain k-means to start with
            for _ in range(4):
                at = ((x[:, None, s] - self.centres[i][None]) ** 2).sum(2).argmin(1)
                for c in range(CENTRES):
                    if (at == c).any():
                        self.centres[i][c] = x[at == c][:, s].mean(0)
        for _ in range(rounds):
            self._refit(x, self.code(x))

    def code(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent: each subspace in turn, given the others' parallel residual."""
        codes = np.zeros((len(x), len(self.spaces)), np.uint8)
        along = np.zeros((len(x), len(self.spaces)))
        for i, s in enumerate(self.spaces):
            codes[:, i] = ((x[:, None, s] - self.centres[i][None]) ** 2).sum(2).argmin(1)
            along[:, i] = ((x[:, s] - self.centres[i][codes[:, i]]) * x[:, s]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for i, s in enumerate(self.spaces):
                rest = total - along[:, i]
                off = x[:, None, s] - self.centres[i][None]
                mine = (off * x[:, None, s]).sum(2)
                cost = (off * off).sum(2) + (self.parallel - 1) * (rest[:, None] + mine) ** 2
                codes[:, i] = cost.argmin(1)
                along[:, i] = mine[np.arange(len(x)), codes[:, i]]
                total = rest + along[:, i]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The centres that minimise the loss for given codes: one linear system over all of them."""
        sizes = [len(s) * CENTRES for s in self.spaces]
        first = np.concatenate(([0], np.cumsum(sizes)))
        v = np.zeros((len(x), first[-1]))
        counts = np.zeros(first[-1])
        rows = np.arange(len(x))
        for i, s in enumerate(self.spaces):
            for j in range(len(s)):
                column = first[i] + codes[:, i].astype(int) * len(s) + j
                v[rows, column] = x[:, s[j]]
                np.add.at(counts, column, 1)
        a = (self.parallel - 1) * (v.T @ v) + np.diag(counts)
        b = v.T @ (1 + (self.parallel - 1) * (x * x).sum(1))
        old = np.concatenate([c.ravel() for c in self.centres])
        a += 1e-6 * np.eye(len(a))  # unused centres stay
        found = np.linalg.solve(a, b + 1e-6 * old)
        self.centres = [found[first[i] : first[i + 1]].reshape(CENTRES, -1) for i in range(len(self.spaces))]

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What coding loses of each unit vector: its residual along the vector, and the length of the rest of it."""
        off = np.empty_like(x)
        for i, s in enumerate(self.spaces):
            off[:, s] = x[:, s] - self.centres[i][codes[:, i]]
        along = (off * x).sum(1)
        return along, np.sqrt(np.maximum((off * off).sum(1) - along * along, 0))

    @staticmethod
    def least(cosine: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
        """The least table score of rows of such residuals whose cosine to a unit query is not below the given one.

        A query at cosine c to a row x is c x + sqrt(1 - c^2) u with a unit u orthogonal to x, so its product with the
        coded row is at least c (1 - along) - sqrt(1 - c^2) across; this is least at the smallest c, or where it turns.
        """
        a = 1 - along
        turn = -a / np.maximum(np.sqrt(a * a + across * across), 1e-300)
        c = np.clip(np.maximum(cosine[:, None], turn), -1, 1)
        return c * a - np.sqrt(1 - c * c) * across

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.column_stack((codes, np.zeros(len(codes), np.uint8)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of code, the inner products of its 256 values."""
        parts = [queries[:, s] @ self.centres[i].T for i, s in enumerate(self.spaces)]
        if len(parts) % 2:
            parts.append(np.zeros((len(queries), CENTRES)))
        return np.stack([(a[:, :, None] + b[:, None, :]).reshape(len(queries), 256) for a, b in zip(parts[::2], parts[1::2])], 1).astype(np.float32)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores wherever they stand."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def search_block(quantiser: Quantiser, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int = K) -> pd.DataFrame:
    """The k best of one block of rows for each query."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], np.ascontiguousarray(rows[order])
    keys = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    copies = [np.unique(ids[by_group[s:e]])[: k + 1] for s, e in zip(bounds[:-1], bounds[1:])]
    rows = rows[first]
    unit = rows / np.sqrt((rows * rows).sum(1))[:, None]
    codes = quantiser.code(unit)
    along, across = quantiser.residuals(unit, codes)
    codes = quantiser.packed(codes).T.copy()
    keep = min(len(rows), max(LEAST, k + 1, -(-len(rows) // KEEP)))
    out = []
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        tables = quantiser.tables(part / np.sqrt((part * part).sum(1))[:, None])
        score = np.zeros((len(part), len(rows)), np.float32)
        for j, code in enumerate(codes):
            score += tables[:, j][:, code]
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        exact = _cosine(part[:, None, :], rows[best])
        if keep < len(rows):
            # A query may be one of the rows, so of different rows the k + 1 best are the bound.
            bound = np.partition(exact, keep - k - 1, axis=1)[:, keep - k - 1]
            # Single precision rounds every table entry and every addition.
            slack = 1e-9 + (len(codes) + 2) * 2.0**-23 * np.abs(tables).max(2).sum(1, dtype=np.float64)
            more = ~(score < quantiser.least(bound - 1e-9, along, across) - slack[:, None])
            np.put_along_axis(more, best, False, axis=1)
        for i in range(len(part)):
            scored, at_rows = exact[i], best[i]
            if keep < len(rows) and len(rest := np.flatnonzero(more[i])):
                scored, at_rows = np.concatenate((scored, _cosine(part[i][None], rows[rest]))), np.concatenate((at_rows, rest))
            if len(scored) > k + 1:  # all that tie with the k + 1 best
                top = scored >= np.partition(scored, len(scored) - k - 1)[len(scored) - k - 1]
                scored, at_rows = scored[top], at_rows[top]
            found = sorted((-s, v) for s, g in zip(scored.tolist(), at_rows.tolist()) for v in copies[g].tolist() if v != query_ids[at + i])[:k]
            out += [(int(query_ids[at + i]), v, -s) for s, v in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def coarse(x: np.ndarray, n: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """n unit centres of unit vectors, by spherical k-means."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), n, replace=False)]
    for _ in range(rounds if n > 1 else 0):
        at = (x @ centres.T).argmax(1)
        for c in np.unique(at):
            mean = x[at == c].mean(0)
            if (size := np.sqrt((mean * mean).sum())) > 0:
                centres[c] = mean / size
    return centres


def looks(x: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """In how many lists a query must look to find that share of its k nearest, by the sample x against itself.

    Neighbours among all rows are nearer than those in a sample, so they are found at least as often.
    """
    if len(centres) == 1 or len(x) <= k + 1:
        return len(centres)
    asked = x[: min(ASKED, len(x))]
    best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], 1)
    lists = (x @ centres.T).argmax(1)
    needed = np.sort(np.take_along_axis(place, lists[best], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def nearest(table: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score.  Both have vec_id and embedding."""

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)

    rows = valid(table)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = table.sparkSession
    result = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == sizes["d"])
    asked = valid(queries).filter(F.size("embedding") == sizes["d"])
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["embedding"])
    unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
    centres = coarse(unit, int(np.clip(sizes["count"] // PER_LIST, 1, min(CENTRES_MOST, len(unit)))))
    n_looks = looks(unit, centres, k)
    held = spark.sparkContext.broadcast((Quantiser(unit), centres))

    def lists_of(n: int):
        """The n nearest centres of each vector, nearest first."""

        def of(vectors: pd.Series) -> pd.Series:
            x = _matrix(vectors)
            near = (x / np.sqrt((x * x).sum(1))[:, None]) @ held.value[1].T
            return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return F.pandas_udf(of, "array<int>")("embedding")

    listed = written(rows.withColumn("list", F.get(lists_of(1), F.lit(0))))
    sized = {r.list: r["count"] for r in listed.groupBy("list").count().collect()}  # one row a centre
    # All lists that hold rows, in a query's order; it stops at n_looks of them, or later if those hold too few rows.
    held_rows = np.zeros(len(centres), np.int64)
    held_rows[list(sized)] = list(sized.values())
    enough = int(min(k + 1, held_rows.sum()))

    def looked_into(vectors: pd.Series) -> pd.Series:
        x = _matrix(vectors)
        order = np.argsort(-((x / np.sqrt((x * x).sum(1))[:, None]) @ held.value[1].T), axis=1, kind="stable")
        have = np.cumsum(held_rows[order], axis=1)
        n = np.maximum(n_looks, (have < enough).sum(1) + 1)
        return pd.Series([o[:m][held_rows[o[:m]] > 0].astype(np.int32) for o, m in zip(order, n)])

    asked = written(asked.distinct().withColumn("lists", F.pandas_udf(looked_into, "array<int>")("embedding")))
    wanted = {r.list: r["count"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}
    parts = F.array(*[F.lit(-(-int(held_rows[c]) // ROWS)) for c in range(len(centres))])
    groups = F.array(*[F.lit(-(-wanted.get(c, 0) // QUERIES)) for c in range(len(centres))])

    def dealt(df: DataFrame, salt: int, own: Column, others: Column, own_name: str, other_name: str) -> DataFrame:
        """Each row in a block of its own kind, and once for every block of the other."""
        mine = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.get(own, F.col("list"))).cast("int")
        return df.filter(F.get(others, F.col("list")) > 0).select("vec_id", "embedding", "list", mine.alias(own_name), F.explode(F.sequence(F.lit(0), F.get(others, F.col("list")) - 1)).alias(other_name))

    left = dealt(asked.select("vec_id", "embedding", F.explode("lists").alias("list")), 1, groups, parts, "q", "c")
    right = dealt(listed, 7, parts, groups, "c", "q")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(held.value[0], a["vec_id"].to_numpy(), _matrix(a["embedding"]), b["vec_id"].to_numpy(), _matrix(b["embedding"]), k)

    found = left.groupBy("list", "q", "c").cogroup(right.groupBy("list", "q", "c")).applyInPandas(block, result)
    # One shuffle serves both; of rows with one vec_id the nearest counts.
    ranked = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.filter(f"vec_id % {EVERY} = 0"))
