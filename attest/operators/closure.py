"""Reachability over directed edges, cycles and self-loops included.

There are three ways to the same pairs; each bound is tested on the edges themselves, never assumed:

* up to ``DRIVER_EDGES`` edges and ``DRIVER_PAIRS`` pairs: on the driver, so that the result is part of the plan;
* up to ``SENT_EDGES`` edges: the edges go to every executor (some megabytes), and each start is walked where it is, so
  there are no rounds, and pairs are made by all executors and moved by none;
* beyond: rounds of joins, each ended by a reliable checkpoint, so lineage stays short and a lost executor costs one
  round.  All pairs come by path doubling: a round joins the pairs that the last one found with all that are known, and a
  chain of n nodes takes about log2(n) rounds.  Where paths start at given seeds only, doubling would find pairs of all
  nodes; there a round takes the last one's pairs one edge further.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_table
from .durable import settled

DRIVER_EDGES = 2_000
DRIVER_PAIRS = 20_000
SENT_EDGES = 200_000
PAIRS = "src string, dst string"
#: Pairs of a batch, about.
WALKED = 200_000
#: Rounds whose pairs are kept apart.
PARTS = 8


def _small(edges: DataFrame, limit: int) -> list[tuple[str, str]] | None:
    """All edges, if there are no more than limit."""
    if limit <= 0:
        return None
    rows = edges.select("src", "dst").limit(limit + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= limit else None


def _walk(after: dict[str, set[str]], start: str) -> set[str]:
    seen, open_ = {start}, [start]
    while open_:
        for node in after.get(open_.pop(), ()):
            if node not in seen:
                seen.add(node)
                open_.append(node)
    return seen - {start}


def _few(seeds: DataFrame, limit: int) -> list:
    """The seeds, if there are no more than limit; else none, which stands for every node."""
    rows = seeds.select("src").distinct().limit(limit + 1).collect()
    return rows if len(rows) <= limit else []


def _closed(edges: list[tuple[str, str]], starts: set[str] | None) -> list[tuple[str, str]] | None:
    """All pairs of few edges, or those from some starts; None if there are more than DRIVER_PAIRS."""
    after: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    pairs: list[tuple[str, str]] = []
    for a in sorted(set(after) & starts if starts else after):
        pairs += [(a, b) for b in sorted(_walk(after, a))]
        if len(pairs) > DRIVER_PAIRS:
            return None
    return pairs


def _walked(spark, edges: list[tuple[str, str]], starts: DataFrame) -> DataFrame:
    """Pairs from starts(src), each walked on an executor over edges that all of them hold."""
    names = sorted({n for e in edges for n in e})
    number = {n: i for i, n in enumerate(names)}
    after: list[list[int]] = [[] for _ in names]
    for a, b in edges:
        after[number[a]].append(number[b])
    held = spark.sparkContext.broadcast((names, number, after))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, number, after = held.value
        text = np.array(names, object)
        for pdf in batches:
            src, dst, size = [], [], 0
            for name in pdf["src"]:
                start = number.get(name)
                if start is None:
                    continue
                seen = bytearray(len(names))
                seen[start] = 1
                found, open_ = [], [start]
                while open_:
                    for node in after[open_.pop()]:
                        if not seen[node]:
                            seen[node] = 1
                            found.append(node)
                            open_.append(node)
                src.append(np.repeat(start, len(found)))
                dst.append(np.array(found, np.int64))
                size += len(found)
                if size > WALKED:
                    yield pd.DataFrame({"src": text[np.concatenate(src)], "dst": text[np.concatenate(dst)]})
                    src, dst, size = [], [], 0
            if size:
                yield pd.DataFrame({"src": text[np.concatenate(src)], "dst": text[np.concatenate(dst)]})

    return starts.repartition(spark.sparkContext.defaultParallelism).mapInPandas(walk, PAIRS)


def closure(edges: DataFrame, seeds: DataFrame | None = None, driver_edges: int = DRIVER_EDGES, sent_edges: int | None = None) -> DataFrame:
    """(src, dst): what each node reaches by one edge or more, itself left out.

    edges(src, dst) as text.  seeds(src) restricts where paths start; without them every node does.  Without driver_edges
    nothing is done on the driver, and without sent_edges, which are as many as driver_edges allow, no edges are sent.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    some = _small(edges, driver_edges and (SENT_EDGES if sent_edges is None else sent_edges))
    if some is not None and len(some) <= driver_edges and (pairs := _closed(some, None if seeds is None else {r[0] for r in _few(seeds, len(some))})) is not None:
        found = small_table(spark, pairs, PAIRS)
        return found if seeds is None else found.join(seeds.select("src").distinct(), "src", "left_semi")
    if some is not None:
        return _walked(spark, some, edges.select("src").distinct() if seeds is None else seeds.select("src").distinct())
    edges = settled(edges.filter("src <> dst"))
    new = edges if seeds is None else settled(edges.join(seeds.select("src").distinct(), "src", "left_semi"))
    parts = [new]
    while not new.isEmpty():
        known = reduce(DataFrame.union, parts)
        step = (known if seeds is None else edges).select(F.col("src").alias("via"), F.col("dst").alias("next"))
        further = new.join(step, new["dst"] == step["via"]).select("src", F.col("next").alias("dst")).filter("src <> dst").distinct()
        new = settled(further.join(known, ["src", "dst"], "left_anti"))
        parts.append(new)
        if len(parts) > PARTS:  # each round writes what it found; all of it is written anew only now and then
            parts = [settled(reduce(DataFrame.union, parts))]
    return reduce(DataFrame.union, parts)


def reachable(edges: DataFrame, start: str, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(dst): what one node reaches, itself left out."""
    seeds = small_table(edges.sparkSession, [(start,)], "src string")
    return closure(edges, seeds, driver_edges).select("dst").orderBy("dst")
