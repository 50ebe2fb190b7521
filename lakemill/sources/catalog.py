"""Metadata relations over the views and tables of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def information_schema_schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("main", "main")], "catalog_name string, schema_name string")


def information_schema_tables(spark: SparkSession) -> DataFrame:
    rows = [("main", "main", t.name, "VIEW" if t.isTemporary else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def information_schema_columns(spark: SparkSession, tables: list[str] | None = None) -> DataFrame:
    rows = []
    for name in tables or [t.name for t in spark.catalog.listTables()]:
        for k, f in enumerate(spark.table(name).schema.fields, 1):
            rows.append(("main", name, f.name, k, "YES" if f.nullable else "NO", f.dataType.simpleString()))
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def pragma_table_info(spark: SparkSession, name: str, primary_key: tuple[str, ...] = ()) -> DataFrame:
    rows = [(k, f.name, f.dataType.simpleString(), int(not f.nullable), None, primary_key.index(f.name) + 1 if f.name in primary_key else 0) for k, f in enumerate(spark.table(name).schema.fields)]
    return spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")


def pragma_table_list(spark: SparkSession) -> DataFrame:
    rows = [("main", t.name, "view" if t.isTemporary else "table", len(spark.table(t.name).columns)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "schema string, name string, type string, ncol int")
