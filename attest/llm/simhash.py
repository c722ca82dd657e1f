"""SimHash near-duplicates by the generalised pigeonhole principle.

``fingerprints`` gives each whole text its 64-bit SimHash of four-word shingles.  ``link_edges`` finds which
fingerprints differ in few bits: bits that vary together are put into one partition, a dynamic program gives
each partition its own threshold t (the thresholds of m partitions sum to tau - m + 1) from estimated candidate
counts, every fingerprint is sent to the keys of its partitions within t bits, and pairs that meet are verified.
A partition of threshold -1 is not probed.  The probed keys grow longer with the number of fingerprints, so
candidates stay in proportion to the input.

Cases: null or word-less texts have fingerprint zero, linked like any other; fewer than four words are one
shingle; repeated rows give repeated result rows; a null doc_id takes part and is never a component's id, unless
the component has nothing else (then null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, min_components, release, written

SHINGLE = 4
TAU = 4
BITS = 64
#: The bound of the sample on which bits are grouped and thresholds allocated; links never depend on it.
SAMPLE = 20_000
#: Probes in a partition where they meet, on average.
MEET = 500_000
#: A bucket above this size is split again by the bits that its key does not hold, still exactly.
SPLIT = 3_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The SimHash of one text: a bit is 1 if set in over half of the shingles' XXH64 values."""
    # Only A-Z are lowered, which in UTF-8 is bytes.lower().
    joined, starts, ends = byte_words(text)
    if not len(starts):
        return 0
    joined = joined.lower()
    n = max(1, len(starts) - shingle + 1)
    last = ends[min(shingle, len(ends)) - 1 :]
    of = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([of(joined[s:e], seed) for s, e in zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist())], np.uint64)
        # Bytes hold up to 255 ones, so bits are summed 255 rows at a time.
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """A long column with the bits of each text's fingerprint."""

    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        release()
        return out

    return F.pandas_udf(of, T.LongType())(docs[text])


# --- partitions and thresholds ---------------------------------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits; each is grown from a free bit by the free bits that correlate most with it."""
    size = [BITS // m + (i < BITS % m) for i in range(m)]
    if len(sample) < 2:
        return np.split(np.arange(BITS), np.cumsum(size)[:-1])
    x = _bits(sample).astype(np.float64)
    x = (x - x.mean(0)) / (x.std(0) + 1e-9)
    like = np.abs(x.T @ x) / len(x)
    free, groups = list(range(BITS)), []
    for k in size:
        rest = like[np.ix_(free, free)].sum(1)
        group = [free.pop(int(rest.argmax()))]
        while len(group) < k:
            group.append(free.pop(int(like[np.ix_(free, group)].sum(1).argmax())))
        groups.append(sorted(group))
    return groups


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed."""
    out = np.zeros(len(fps), np.uint64)
    for at, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
    return out


def masks(k: int, t: int) -> np.ndarray:
    """All masks of at most t of k bits."""
    return np.array([sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(k), r)], np.uint64)


def allocate(sample: np.ndarray, total: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The partitions and thresholds of least estimated cost over all partition counts.

    A partition's cost at threshold t is its probes (n times the masks of t bits) and its candidates: the pairs of
    sample fingerprints within t bits there, scaled to all fingerprints.  The dynamic program shares out
    tau - m + 1 among the m partitions, each getting -1 or more.
    """
    scale = total / max(1, len(sample))
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(2, tau + 2):
        groups = group_bits(sample, m)
        costs = []
        for g in groups:
            values, counts = np.unique(project(sample, g), return_counts=True)
            cost = {-1: 0.0}
            for t in range(tau + 1):
                if sum(comb(len(g), r) for r in range(t + 1)) > 4096:
                    break
                probes = masks(len(g), t)
                pairs = 0.0
                for x in probes:
                    at = np.searchsorted(values, values ^ x)
                    at[at == len(values)] = 0
                    pairs += float((counts * np.where(values[at] == values ^ x, counts, 0)).sum())
                # Candidates that the sample is too thin to hold are those of evenly spread keys.
                even = total * total * len(probes) / 2.0 ** len(g)
                cost[t] = 4.0 * total * len(probes) + max(pairs * scale * scale / max(1.0, scale), even) / 8.0
            costs.append(cost)
        want = tau - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t, extra in cost.items():
                    if s + t not in nxt or c + extra < nxt[s + t][0]:
                        nxt[s + t] = (c + extra, [*ts, t])
            table = nxt
        if want in table and table[want][0] < best[0]:
            best = (table[want][0], [(list(map(int, g)), t) for g, t in zip(groups, table[want][1]) if t >= 0])
    return best[1]


# --- probing and verifying -------------------------------------------------------------------------------------


def _verify(fps: np.ndarray, own: np.ndarray, tau: int, free: list[int], out: list[np.ndarray]) -> None:
    """Edges of a spanning forest of one bucket's links of which one end is its own: at most one per fingerprint.

    A found fingerprint leaves the unseen ones, so a large group of near copies takes few comparisons and no pairs.
    """
    if len(fps) > SPLIT and len(free) > tau:
        # Exact again: tau differing bits among the free ones leave one of tau + 1 parts equal.
        for part in np.array_split(np.array(free), tau + 1):
            key = project(fps, part.tolist())
            order = np.argsort(key, kind="stable")
            rest = [b for b in free if b not in part]
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(group) > 1:
                    _verify(fps[group], own[group], tau, rest, out)
        return
    mine, others = fps[own], fps[~own]
    while len(mine):
        seen, mine = [(mine[0], True)], mine[1:]
        while seen:
            x, is_own = seen.pop()
            near = np.bitwise_count(mine ^ x) <= tau
            if near.any():
                out.append(np.column_stack((np.full(near.sum(), x), mine[near])))
                seen.extend((y, True) for y in mine[near])
                mine = mine[~near]
            if is_own and len(others):
                near = np.bitwise_count(others ^ x) <= tau
                if near.any():
                    out.append(np.column_stack((np.full(near.sum(), x), others[near])))
                    seen.extend((y, False) for y in others[near])
                    others = others[~near]


def link_edges(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """Edges (src, dst) that join every two distinct fingerprints of at most tau differing bits, directly or by others.

    fps: one long column fp of distinct values, in a table that can be read again.
    """
    total = fps.count()
    # A fixed bound: the SAMPLE least values of a hash.
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = allocate(sample, total, tau)
    probes = [(g, masks(len(g), t)) for g, t in parts]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for i, (g, xs) in enumerate(probes):
                base = project(fp, g)
                for at in range(0, len(fp), 4096):
                    k = (base[at : at + 4096, None] ^ xs[None, :]).ravel()
                    yield pd.DataFrame({"part": np.int32(i), "key": k.view(np.int64), "own": np.tile(xs == 0, len(base[at : at + 4096])), "fp": np.repeat(pdf["fp"].to_numpy()[at : at + 4096], len(xs))})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"part": [], "key": [], "own": [], "fp": []})], ignore_index=True)
        out: list[np.ndarray] = []
        if len(pdf):
            part, key, own = pdf["part"].to_numpy(), pdf["key"].to_numpy(), pdf["own"].to_numpy().astype(bool)
            fp = pdf["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((fp, key, part))
            part, key, own, fp = part[order], key[order], own[order], fp[order]
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            for s, e in zip(starts.tolist(), ends.tolist()):
                # Two fingerprints within t bits meet where one of them has the key itself.
                if e - s < 2 or not own[s:e].any():
                    continue
                g = set(probes[int(part[s])][0])
                _verify(fp[s:e], own[s:e], tau, [b for b in range(BITS) if b not in g], out)
        pairs = (np.concatenate(out) if out else np.zeros((0, 2), np.uint64)).view(np.int64)
        pairs = _forest(pairs)
        yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    keyed = fps.select("fp").mapInPandas(keys, "part int, key long, own boolean, fp long")
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * sum(len(xs) for _, xs in probes) // MEET))
    return keyed.repartition(n, "part", "key").mapInPandas(meet, "src long, dst long")


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Of one task's edges, those that a spanning forest needs."""
    if len(pairs) < 2:
        return pairs
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = list(range(len(nodes)))
    kept = []
    for i, (a, b) in enumerate(ends.tolist()):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept]


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """Every row's (doc_id, fp, component_id, root), root being the component's least fingerprint; see the module's text
    for the cases."""
    each = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(docs, text).alias("fp")))
    classes = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = min_components(link_edges(classes, tau))
    # Vertices are fingerprints; a component's id is the least doc_id over its fingerprints.
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(ids, "root").select("fp", "component_id", "root")
    return each.join(names, "fp").select("doc_id", "fp", "component_id", "root")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id.

    Where rows share a doc_id or have none, the fingerprint tells them apart, and of a component's rows that still tie
    the least (as a struct of all columns) stays.
    """
    found = written(components(docs))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(least).alias("stays")).filter("stays")
    stay = docs.join(ids.filter("n = 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    unclear = ids.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    if not unclear.head(1):
        return stay
    names = found.filter(least).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "root").distinct()
    rows = docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["_id"]), "left_semi").select(F.struct(*docs.columns).alias("row"), fingerprints(docs).alias("_fp"))
    rows = rows.join(names, (rows["_fp"] == names["_fp"]) & rows["row.doc_id"].eqNullSafe(names["_id"])).groupBy("root").agg(F.min("row").alias("row"))
    return stay.unionByName(rows.select("row.*"))


def query(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
