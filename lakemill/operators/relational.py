"""Relational operators that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.session import checkpoint_dir

RECURSION_LIMIT = 1000


def distinct_on(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (which should be total)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = RECURSION_LIMIT) -> DataFrame:
    """WITH RECURSIVE: rows of start, and of step over the rows that each round adds.

    distinct drops rows that have been seen (UNION), which ends on cycles; else
    all rows count (UNION ALL).  Each round is a checkpoint, so lineage stays
    short and a lost executor costs no more than the round's files.
    """
    checkpoint_dir(start.sparkSession)
    frontier = (start.distinct() if distinct else start).checkpoint()
    seen, rounds = frontier, 0
    while not frontier.isEmpty():
        rounds += 1
        if rounds > limit:
            raise RuntimeError(f"recursion went over {limit} rounds")
        new = step(frontier).select(*start.columns)
        new = new.distinct().exceptAll(seen.intersect(new.distinct())) if distinct else new
        frontier = new.checkpoint()
        seen = seen.unionAll(frontier)
    return seen


_SWAP = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def filter_any(df: DataFrame, value: str, op: str, sub: DataFrame) -> DataFrame:
    """WHERE value op ANY (sub): a row of sub for which the comparison is true.

    An order comparison needs only sub's least or greatest value, so no pair of
    rows is ever formed; = is a semi join.
    """
    s = sub.toDF("__v")
    if op == "=":
        return df.join(s, F.col(value) == F.col("__v"), "left_semi")
    return _with_ends(df, s).where(_any(F.col(value), op)).select(*df.columns)


def filter_all(df: DataFrame, value: str, op: str, sub: DataFrame) -> DataFrame:
    """WHERE value op ALL (sub): true for an empty sub, not true where a null of sub leaves it open."""
    s = sub.toDF("__v")
    if op == "<>":
        return _with_ends(df.join(s, F.col(value) == F.col("__v"), "left_anti"), s).where((F.col("__n") == 0) | (F.col(value).isNotNull() & (F.col("__nulls") == 0))).select(*df.columns)
    lo, hi = F.col("__lo"), F.col("__hi")
    x = F.col(value)
    holds = {"=": (x == lo) & (x == hi), "<": x < lo, "<=": x <= lo, ">": x > hi, ">=": x >= hi}[op]
    return _with_ends(df, s).where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & holds)).select(*df.columns)


def _with_ends(df: DataFrame, s: DataFrame) -> DataFrame:
    ends = s.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__v").isNull(), 1)).alias("__nulls"))
    # One row of aggregates.
    return df.crossJoin(F.broadcast(ends))


def _any(x: Column, op: str) -> Column:
    lo, hi = F.col("__lo"), F.col("__hi")
    return {"<>": (x != lo) | (x != hi), "<": x < hi, "<=": x <= hi, ">": x > lo, ">=": x >= lo}[op]


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= point <= high, for numbers.

    Both sides meet in buckets of the given width (about a typical range), so
    the join is an equi-join with a recheck and not a nested loop.
    """
    p = points.withColumn("__bucket", F.floor(F.col(point) / width))
    r = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).where(F.col(low) <= F.col(high))
    return p.join(r, "__bucket").where(F.col(point).between(F.col(low), F.col(high))).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row of left with the last values of right at or before its on, within by.

    One sort of the union per key instead of a join of all earlier pairs.
    """
    a = left.withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    b = right.select(*by, on, F.lit(0).alias("__side"), F.struct(*values).alias("__r"))
    w = W.partitionBy(*by).orderBy(on, "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__r", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])
