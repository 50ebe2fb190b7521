"""Registration of user functions: scalar, table, aggregate and collation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Functions:
    """User functions of one session, Arrow-batched; null arguments give null unless called_on_null."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.collations: dict[str, Callable[[Column], Column]] = {}

    def scalar(self, name: str, returns: str, f: Callable, called_on_null: bool = False):
        """f of plain values, run over Arrow batches."""

        def run(*columns: pd.Series) -> pd.Series:
            rows = zip(*columns)
            return pd.Series([f(*r) if called_on_null or not any(pd.isna(v) for v in r) else None for r in rows])

        # The number of arguments shows in the signature that Spark reads.
        made = F.pandas_udf(_with_arity(run, f.__code__.co_argcount), returns)
        self.spark.udf.register(name, made)
        return made

    def vector(self, name: str, returns: str, f: Callable):
        """f of pandas Series."""
        made = F.pandas_udf(f, returns)
        self.spark.udf.register(name, made)
        return made

    def aggregate(self, df: DataFrame, keys: list[str], value: str, name: str, returns: str, start, step: Callable, finish: Callable) -> DataFrame:
        """A step/finalise aggregate by key, over a group's values in Arrow batches."""

        def run(values: pd.Series):
            state = start
            for v in values.dropna():
                state = step(state, v)
            return finish(state)

        run.__annotations__ = {"values": pd.Series, "return": float}
        return df.groupBy(*keys).agg(F.pandas_udf(run, returns)(F.col(value)).alias(name))

    def table(self, name: str, returns: str, cls: type):
        made = F.udtf(cls, returnType=returns)
        self.spark.udtf.register(name, made)
        return made

    def collation(self, name: str, key: Callable[[Column], Column]) -> None:
        """A collation as a sort and comparison key."""
        self.collations[name] = key

    def collate(self, name: str, x: Column | str) -> Column:
        return self.collations[name](F.col(x) if isinstance(x, str) else x)


def _with_arity(run: Callable, n: int) -> Callable:
    names = ", ".join(f"a{k}" for k in range(n))
    made: dict = {}
    exec(f"def f({', '.join(f'a{k}: pd.Series' for k in range(n))}) -> pd.Series:\n    return run({names})", {"run": run, "pd": pd}, made)  # noqa: S102
    return made["f"]
