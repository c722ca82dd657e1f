"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from attest.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    top = "/root/testdata/sf0.001"
    if not os.path.isdir(top):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for f in os.listdir(top):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{top}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    rows = found.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found.columns, rows) == rows_of(want.columns, want.fetchall())


def test_the_entry_module_offers_them(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
