"""Scalar functions against Python, and the closed tables."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attest.errors import LabelError, UnitError
from attest.functions import labels, text, units, vocabulary
from attest.functions.parse import is_blank, is_integer, is_number, number
from attest.operators.estimators import average_ranks
from attest.operators.profile import profile

CELLS = ["1", " 1 ", "1_000", "1__0", "_1", "1_", "1.5d", "1.5f", "1,5", "0x10", "1e5", "1E-3", "-.5", "5.", ".", "+7", "--7", "nan", "inf", "-inf", "", "  ", "1e", "1_0.2_5e1_0", "\t2\n", "1e400"]


def python_number(cell: str):
    try:
        v = float(cell)
    except ValueError:
        return None
    return v if math.isfinite(v) else None


def test_numbers_are_read_as_python_reads_them(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "c string")
    got = {r.c: (r.v, r.i) for r in df.select("c", number(F.col("c")).alias("v"), is_integer(F.col("c")).alias("i")).collect()}
    for c in CELLS:
        assert got[c][0] == python_number(c), c
        try:
            whole = int(c) is not None
        except ValueError:
            whole = False
        assert got[c][1] == whole, c


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789_.eE+- fdx", max_size=7), min_size=1, max_size=60))
def test_any_text_is_read_alike(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r.v for r in df.select(number(F.col("c")).alias("v")).collect()] == [python_number(c) for c in cells]


def test_nulls_are_blank_and_no_number(spark):
    r = spark.createDataFrame([(None,)], "c string").select(is_blank(F.col("c")), is_integer(F.col("c")), is_number(F.col("c")), number(F.col("c"))).first()
    assert tuple(r) == (True, False, False, None)


def test_profiles(spark):
    rows = [("1", "x", "", "1.5", "1"), ("2", "", " ", "2", "inf"), (None, "y", "", "", "3")]
    got = {r.column: (r.n_filled, r.type) for r in profile(spark.createDataFrame(rows, "a string, b string, c string, d string, `e.f` string")).collect()}
    assert got == {"a": (2, "sc:Integer"), "b": (2, "sc:Text"), "c": (0, "sc:Text"), "d": (2, "sc:Float"), "e.f": (3, "sc:Text")}
    assert [r.n_rows for r in profile(spark.createDataFrame([], "a string")).collect()] == [0]


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 1.0, 2.0, 5.0, 5.0, 5.0)] + [(1, 3.0)], "claim int, v double")
    got = sorted((r.claim, r.v, r.k) for r in average_ranks(df, "v", "k").collect())
    assert got == [(0, 1.0, 1.5), (0, 1.0, 1.5), (0, 2.0, 3.0), (0, 5.0, 5.0), (0, 5.0, 5.0), (0, 5.0, 5.0), (1, 3.0, 1.0)]


def test_units(spark):
    assert units.factor("kcal/mol", "kJ/mol") == 4.184 and units.factor("eV", "eV") == 1.0
    for a, b in (("furlong", "nm"), ("nm", "furlong"), ("nm", "ps"), ("eV", "kcal/mol")):
        with pytest.raises(UnitError):
            units.factor(a, b)
    df = spark.createDataFrame([(2.0, "nm", "0.1 nm")], "v double, a string, b string")
    assert units.converted(df, "v", "a", "b").first().converted == 20.0
    with pytest.raises(Exception, match="no factor"):
        units.converted(spark.createDataFrame([(2.0, "nm", "ps")], "v double, a string, b string"), "v", "a", "b").collect()


def test_label_rules(spark):
    rule = labels.LabelRule("r", "a", "e", "x > 1")
    assert labels.rate(1, 4, rule)["rate"] == 0.25
    for n, total in ((1, 0), (5, 4), (-1, 4)):
        with pytest.raises(LabelError):
            labels.rate(n, total, rule)
    with pytest.raises(LabelError):
        labels.LabelRule("r", " ", "e", "x")
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", None), ("b", 1)], "g string, y int")
    assert {r.g: (r.n_positive, r.n_total, r.rate) for r in labels.rates(df, "g", "y", rule).collect()} == {"a": (1, 2, 0.5), "b": (1, 1, 1.0)}
    for bad in ([("a", 2)], [("a", None)]):
        with pytest.raises(Exception, match="label|rate"):
            labels.rates(spark.createDataFrame(bad, "g string, y int"), "g", "y", rule).collect()


def test_text(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    lit = F.lit
    assert one(text.slug(lit("a.b c"))) == "a_b_c" and one(text.slug(lit(" Größe (nm)"), "-", True)) == "größe-nm"
    assert one(text.media_type(lit("x/y.JSONLD"))) == "application/ld+json" and one(text.media_type(lit("a.b/c"))) == "application/octet-stream"
    assert one(text.bare_digest(lit("sha256:ab"))) == "ab" and one(text.bare_digest(lit("ab"))) == "ab"
    for path in ("results/a.csv", "ü/??>>~~", "abc", ""):
        assert one(text.store_key(text.store_name(lit(path)))) == path
    assert one(text.is_timestamp(lit("2024-01-01"))) and not one(text.is_timestamp(lit("1.1.2024")))
    assert one(text.as_datetime(lit("2024-01-01"))) == "2024-01-01T00:00:00"
    assert one(text.sentences(lit("One. Two; Three. Four"), 2)) == "One. Two;"
    with pytest.raises(Exception, match="no access right"):
        one(text.access_right(lit("secret")))


def test_the_vocabulary_is_closed_and_consistent(spark):
    assert vocabulary.statuses(spark).count() == 7 and vocabulary.node_kinds(spark).count() == 7
    for stale, doubt, meaning in vocabulary.PREDICATES.values():
        assert stale in ("backward", "forward", None) and doubt in vocabulary.DOUBT_KINDS and meaning
    assert set(vocabulary.STATUS_MEANINGS) == set(vocabulary.STATUSES)
    differ = [k for k, (_, is_open, carries) in vocabulary.STATUSES.items() if is_open != carries]
    assert differ == ["falsified"]
