"""Table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES_LIMIT = 1_000_000


def generate_series(start, stop, step=None) -> Column:
    """To explode: inclusive, empty against the step's direction, none for a null."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    s = F.lit(1) if step is None else step if isinstance(step, Column) else F.lit(step)
    if isinstance(step, int) and step == 0:
        raise ValueError("the step can't be 0")
    forward = isinstance(step, int) and step > 0 or step is None
    if isinstance(step, Column):
        return F.when(a <= b, F.sequence(a, F.greatest(a, b), s))
    ok = a <= b if forward else a >= b
    return F.when(ok, F.sequence(a, F.when(ok, b).otherwise(a), s))


def json_each(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """key, value and type of each item at the top level; a scalar gives one row with a null key."""
    return _walk(df, column, keep, deep=False)


def json_tree(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """key, value, type and path of all items, parents first."""
    return _walk(df, column, keep, deep=True)


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]


def _text(v) -> str | None:
    if v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def walk(v, key: str | None = None, path: str = "$") -> Iterator[tuple[str | None, str | None, str, str]]:
    yield key, _text(v), _kind(v), path
    if isinstance(v, dict):
        for k in sorted(v):
            yield from walk(v[k], k, f"{path}.{k}")
    elif isinstance(v, list):
        for k, x in enumerate(v):
            yield from walk(x, str(k), f"{path}[{k}]")


def _walk(df: DataFrame, column: str, keep: tuple[str, ...], deep: bool) -> DataFrame:
    @F.pandas_udf("array<struct<key:string,value:string,type:string,path:string>>")
    def items(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return []
            v = json.loads(text)
            if deep:
                return list(walk(v))
            if isinstance(v, dict):
                return [(k, _text(v[k]), _kind(v[k]), "$") for k in sorted(v)]
            if isinstance(v, list):
                return [(str(k), _text(x), _kind(x), "$") for k, x in enumerate(v)]
            return [(None, _text(v), _kind(v), "$")]

        return texts.map(one)

    each = df.select(*keep, F.posexplode(items(F.col(column))).alias("pos", "item"))
    return each.select(*keep, "pos", "item.key", "item.value", "item.type", *(["item.path"] if deep else []))
