"""Conditional and general functions that differ from Spark's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_null(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def greatest(*cols) -> Column:
    """The greatest value, or null if any is null."""
    found = [_col(c) for c in cols]
    return F.when(~_any_null(found), F.greatest(*found))


def least(*cols) -> Column:
    """The least value, or null if any is null."""
    found = [_col(c) for c in cols]
    return F.when(~_any_null(found), F.least(*found))


def iif(condition: Column, then, otherwise) -> Column:
    """then where the condition is true; a null condition takes otherwise."""
    return F.when(F.coalesce(condition, F.lit(False)), then).otherwise(otherwise)


def compare(a, b) -> Column:
    """-1, 0 or 1; a number against text compares as numbers where the text is one, else the number is less."""
    a, b = _col(a), _col(b)
    number = b.try_cast("double")
    x = a.cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(number.isNull(), -1).when(x < number, -1).when(x > number, 1).otherwise(0)


def is_distinct_from(a, b) -> Column:
    return ~_col(a).eqNullSafe(_col(b))
