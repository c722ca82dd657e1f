"""What several operators share: tables, shared-folder tables, whole partitions, text as words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.  Texts and pages are long, and a batch is what Spark buffers and a worker holds at once.
BATCH = 1000

_SPACES = str.maketrans({chr(c): " " for c in range(9, 14)})
_own_dir: str | None = None


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH rows, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a parquet table, by Spark's reader only."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set (tests, local mode)."""
    global _own_dir
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="attest-")
    return f"file://{_own_dir}"


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/attest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[str]:
    """The words of a whole text; null has none."""
    if not text:
        return []
    return [w for w in text.translate(_SPACES).split(" ") if w]


def byte_words(text: str | bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words joined by one space as UTF-8, and where each word starts and ends in that."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    joined = b" ".join(raw.split())
    if not joined:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def release() -> None:
    """Give memory that is free back to the system; a worker lives through many tasks of other sizes."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system's library
        pass


def blocks(batches: Iterator, column: str, size: int = 16 << 20) -> Iterator:
    """Join Arrow batches (as pandas) until their texts in ``column`` hold about ``size`` characters."""
    import pandas as pd

    held, total = [], 0
    for pdf in batches:
        held.append(pdf)
        total += int(pdf[column].str.len().sum() or 0) + 8 * len(pdf)
        if total >= size:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held, total = [], 0
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[starts:ends] for each span, by prefix sums."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def min_components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, without any vertex's neighbours in one place.

    edges(src, dst): two non-null long columns.  Returns (node, root), one row per vertex of an edge,
    where root is the component's smallest vertex.  Large-star and small-star rounds, each written to
    the shared folder; a round needs joins and minima only, so a star of any size is split by AQE.
    """
    # ``lo`` is the smaller end.  A graph of stars whose centre is the smallest vertex is a fixed point.
    now = written(
        edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).filter("lo < hi").distinct()
    )
    count = sum_of = None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi"), F.col("lo")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Large star: every larger neighbour of u goes to the least vertex around u.
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # Small star: every smaller neighbour of u, and u, go to the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(
            F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("e")
        )
        now = written(small.select("e.lo", "e.hi").filter("lo < hi").distinct())
        state = now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(lo, hi) as decimal(38, 0)))")).first()
        if not state[0] or tuple(state) == (count, sum_of):
            break
        count, sum_of = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo"), F.col("lo")).distinct())
