"""Views, tables made from queries, and EXPLAIN, in the dialect's text.

A view is a temporary view of the session: Catalyst puts its plan in place of
its name.  A table made from a query is written to the warehouse as Parquet.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lakemill.plans.rewrite import sql

_NAME = r"(?P<name>\w+)"
_VIEW = re.compile(rf"CREATE\s+(?P<replace>OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\s+(?P<kept>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(?:\((?P<columns>[^)]*)\))?\s+AS\s+(?P<query>.*)", re.I | re.S)
_TABLE = re.compile(rf"CREATE\s+TABLE\s+(?P<kept>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+AS\s+(?P<query>.*?)(?:\s+WITH\s+(?P<empty>NO\s+)?DATA)?", re.I | re.S)
_DROP = re.compile(rf"DROP\s+(?P<kind>VIEW|TABLE)\s+(?P<kept>IF\s+EXISTS\s+)?{_NAME}", re.I)
_EXPLAIN = re.compile(r"EXPLAIN\s+(?P<run>ANALYZE\s+)?(?P<query>.*)", re.I | re.S)


def explain(df: DataFrame, analyze: bool = False) -> DataFrame:
    """The formatted plan, a line a row; analyze runs the query and adds its count of rows."""
    lines = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
    if analyze:
        lines.append(f"rows: {df.count()}")
    return df.sparkSession.createDataFrame([(x,) for x in lines], "plan string")


def _create_view(spark: SparkSession, m: re.Match, params: Sequence[object]) -> None:
    if spark.catalog.tableExists(m["name"]) and not m["replace"]:
        if m["kept"]:
            return
        raise ValueError(f"{m['name']} exists")
    df = sql(spark, m["query"], params)
    if m["columns"]:
        df = df.toDF(*(c.strip() for c in m["columns"].split(",")))
    df.createOrReplaceTempView(m["name"])


def _create_table(spark: SparkSession, m: re.Match, params: Sequence[object]) -> None:
    if spark.catalog.tableExists(m["name"]):
        if m["kept"]:
            return
        raise ValueError(f"{m['name']} exists")
    df = sql(spark, m["query"], params)
    (df.where("false") if m["empty"] else df).write.format("parquet").saveAsTable(m["name"])


def _drop(spark: SparkSession, m: re.Match) -> None:
    found = {t.name.lower(): t.isTemporary for t in spark.catalog.listTables()}.get(m["name"].lower())
    view = m["kind"].upper() == "VIEW"
    if found is None or found != view:
        if m["kept"]:
            return
        raise ValueError(f"no {m['kind'].lower()} {m['name']}")
    if view:
        spark.catalog.dropTempView(m["name"])
    else:
        spark.sql(f"DROP TABLE `{m['name']}`")


def execute(spark: SparkSession, text: str, params: Sequence[object] = ()) -> DataFrame | None:
    """Run a statement: CREATE VIEW, CREATE TABLE ... AS, DROP and EXPLAIN here, all others as queries."""
    text = text.strip().rstrip(";").rstrip()
    if m := _VIEW.fullmatch(text):
        return _create_view(spark, m, params)
    if m := _TABLE.fullmatch(text):
        return _create_table(spark, m, params)
    if m := _DROP.fullmatch(text):
        return _drop(spark, m)
    if m := _EXPLAIN.fullmatch(text):
        return explain(sql(spark, m["query"], params), bool(m["run"]))
    return sql(spark, text, params)
