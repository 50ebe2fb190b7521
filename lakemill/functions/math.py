"""Arithmetic and numeric functions: out of a function's domain the result is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """Integer division that truncates; null for a divisor of 0."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def divide(a, b) -> Column:
    """Division of doubles; null for a divisor of 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend; null for a divisor of 0."""
    return F.try_mod(_col(a), _col(b))


def round_(x, digits: int = 0) -> Column:
    """A double, half away from zero."""
    return F.round(_col(x).cast("double"), digits)


def ceil(x) -> Column:
    return F.ceil(_col(x)).cast("double")


def floor(x) -> Column:
    return F.floor(_col(x)).cast("double")


def sqrt(x) -> Column:
    return F.when(_col(x) >= 0, F.sqrt(_col(x)))


def sign(x) -> Column:
    return F.signum(_col(x)).cast("long")


def ln(x) -> Column:
    return F.when(_col(x) > 0, F.ln(_col(x)))


def log(*args) -> Column:
    """Base 10, or the base as the first of two arguments."""
    x = _col(args[-1])
    if len(args) == 1:
        return F.when(x > 0, F.log10(x))
    base = _col(args[0])
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def tan(x) -> Column:
    return F.when(F.abs(F.cos(_col(x))) >= 1e-12, F.tan(_col(x)))


def asin(x) -> Column:
    return F.when(F.abs(_col(x)) <= 1, F.asin(_col(x)))


def acos(x) -> Column:
    return F.when(F.abs(_col(x)) <= 1, F.acos(_col(x)))


def cot(x) -> Column:
    return F.when(F.abs(F.sin(_col(x))) >= 1e-12, F.cot(_col(x)))
