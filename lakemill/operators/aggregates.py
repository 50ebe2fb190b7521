"""Aggregates with the SQL dialect's result types and null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    """Sum as a double, 0.0 over nothing."""
    return F.coalesce(F.sum(_col(x).cast("double")), F.lit(0.0))


def string_agg(x, sep: str = ",", order: Column | str | None = None, distinct: bool = False) -> Column:
    """Values joined in the order of order (else their own); nulls are skipped, none gives null.

    The values of a group meet in one row, as the result itself does.
    """
    x = _col(x).cast("string")
    if distinct:
        joined = F.array_join(F.array_sort(F.collect_set(x)), sep)
    elif order is None:
        joined = F.array_join(F.array_sort(F.collect_list(x)), sep)
    else:
        pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(_col(order).alias("k"), x.alias("x")))))
        joined = F.array_join(F.transform(pairs, lambda p: p["x"]), sep)
    return F.when(F.count(x) > 0, joined)


def array_agg(x, order: Column | str) -> Column:
    """Values as JSON text in the given order; nulls are kept, none gives []."""
    pairs = F.array_sort(F.collect_list(F.struct(_col(order).alias("k"), _col(x).alias("x"))))
    return F.to_json(F.transform(pairs, lambda p: p["x"]), {"ignoreNullFields": "false"})


def median(x) -> Column:
    return F.median(_col(x).cast("double"))


def percentile_cont(x, share: float, descending: bool = False) -> Column:
    """Linear interpolation between the neighbours."""
    if not 0 <= share <= 1:
        raise ValueError("the share is from 0 to 1")
    return F.percentile(_col(x).cast("double"), 1 - share if descending else share)


def percentile_disc(x: str, share: float, kind: str) -> Column:
    """The value of column x at place ceil(n * share), as the input type; counts per value are merged, not values."""
    if not 0 <= share <= 1:
        raise ValueError("the share is from 0 to 1")
    return F.expr(f"percentile_disc({share}D) WITHIN GROUP (ORDER BY `{x}`)").cast(kind)


def count_distinct_over(x, window) -> Column:
    """COUNT(DISTINCT x) OVER, which Spark's windows reject."""
    return F.size(F.collect_set(_col(x)).over(window)).cast("long")
