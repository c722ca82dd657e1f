"""A session with the settings that the engine counts on."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .errors import AttestError


def session(master: str | None = None, **settings: str) -> SparkSession:
    """ANSI arithmetic, adaptive execution and the UTC zone; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName("attest")
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **settings,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """Rows that the plan itself carries, so that steps over them alone take no job.  For declarations and the like."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = list(rows)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


#: Rows that a report lists.
LISTED = 10_000


def listed(df: DataFrame, folder: str | None, name: str, limit: int | None = None) -> list[dict] | dict:
    """df's rows for a report, if there are no more than ``limit`` (LISTED); else they are written by the executors, as JSON
    lines in ``folder``, and the report says where and how many."""
    limit = LISTED if limit is None else limit
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return [r.asDict(recursive=True) for r in rows]
    if folder is None:
        raise AttestError(f"there are more than {limit} {name}; name a folder to write them to")
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").json(path)
    return {"written_to": path, "rows": df.sparkSession.read.text(path).count()}
