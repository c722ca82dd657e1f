"""Queries with more units than one task should number or draw, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from attest.operators import bootstrap
from attest.queries import ORACLES, QUERIES

from .test_queries import rows_of

UNITS = bootstrap.HASH_UNITS + 50


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A folder of tables with UNITS suppliers, and DuckDB over them."""
    top = tmp_path_factory.mktemp("many")
    con = duckdb.connect()
    for name, rows in {
        "lineitem": f"""select i // 3 as l_orderkey, i * 7919 % {UNITS} as l_suppkey, (i % 3)::int as l_linenumber, case when i % 2 = 0 then 'F' else 'O' end as l_linestatus, (i * i % 97)::double as l_quantity,
          (i * i % 97 * 11 + i * 31 % 1009)::double as l_extendedprice, i % 11 / 100.0::double as l_discount, i % 9 / 100.0::double as l_tax from range({UNITS * 2}) r(i)""",
        "orders": f"select i as o_orderkey, (i * 17 % 5003)::double as o_totalprice from range({UNITS}) r(i)",
        "supplier": f"select i as s_suppkey from range({UNITS}) r(i)",
        "nation": "select i as n_nationkey, i % 5 as n_regionkey from range(25) r(i)",
    }.items():
        con.execute(f"copy ({rows}) to '{top}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{top}/{name}.parquet'")
    return str(top), con


def held(spark, many, name):
    found, want = QUERIES[name](spark, many[0]), many[1].sql(ORACLES[name])
    got = rows_of(found.columns, found.collect())
    assert got == rows_of(want.columns, want.fetchall())
    return [dict(zip(sorted(found.columns), r)) for r in got]


@pytest.mark.parametrize("sent", [None, 0])
def test_hashed_draws_of_many_units(spark, many, monkeypatch, sent):
    """Whether sums go to draws or draws to sums."""
    if sent is not None:
        monkeypatch.setattr(bootstrap, "SENT_UNITS", sent)
    (row,) = held(spark, many, "bootstrap_ci_supplier")
    assert row["n_units"] == UNITS and row["ci_lo"] < row["ci_hi"]


def test_every_reason_with_many_units(spark, many):
    """Claims over several numbers of units, one of them with units of its own for each row."""
    rows = {r["id"]: r for r in held(spark, many, "claim_reasons")}
    assert {rows[k]["n_units"] for k in ("no_link", "constant", "nearly_one")} == {UNITS}
    assert (rows["two_units"]["n_units"], rows["blank_unit"]["n_units"], rows["mostly_constant"]["n_units"]) == (2, 1, 5)
    assert len({r["reason_code"] for r in rows.values()}) > 10


def test_verdicts_with_many_units(spark, many):
    rows = {r["id"]: r for r in held(spark, many, "claim_verdicts")}
    assert rows["strong_link"]["n_units"] == UNITS and rows["strong_link"]["verdict"] == "refuted"


def test_tallies_with_many_units(spark, many):
    assert sum(r["n"] for r in held(spark, many, "verdict_tallies")) == 6
