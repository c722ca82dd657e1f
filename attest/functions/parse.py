"""Text cells as numbers, by one grammar for every reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(_\d+)*"
NUMBER = rf"^[+-]?(({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
INTEGER = rf"^[+-]?{_DIGITS}$"


def trimmed(cell: Column) -> Column:
    return F.regexp_replace(cell, r"^\s+|\s+$", "")


def number(cell: Column) -> Column:
    """The cell as a double; null unless it is a finite decimal (digit groups by underscore are fine, suffixes are not)."""
    text = trimmed(cell)
    value = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return finite(value)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def is_blank(cell: Column) -> Column:
    return F.coalesce(trimmed(cell) == "", F.lit(True))


def is_integer(cell: Column) -> Column:
    return F.coalesce(trimmed(cell).rlike(INTEGER), F.lit(False))


def is_number(cell: Column) -> Column:
    return number(cell).isNotNull()
