"""Readers and writers, and versioned table folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.session import TABLES


def register_tables(spark: SparkSession, folder: str, tables: list[str] | None = None) -> None:
    """A temporary view for each table of a folder of Parquet tables."""
    for name in tables or TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = "") -> DataFrame:
    """CSV with a declared schema (no pass over the data to guess one); malformed rows fail."""
    return spark.read.schema(schema).option("header", header).option("nullValue", null).option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_sorted(df: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """Parquet in key order, so that each file's statistics prune seeks and ranges on the keys."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


class Versions:
    """A table as numbered Parquet snapshots with names: time travel over whole versions."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.names: dict[str, int] = {}
        self.last = 0

    def commit(self, df: DataFrame, name: str | None = None) -> int:
        self.last += 1
        df.write.parquet(f"{self.folder}/v{self.last}")
        if name:
            self.names[name] = self.last
        return self.last

    def read(self, at: int | str | None = None) -> DataFrame:
        version = self.names[at] if isinstance(at, str) else at or self.last
        return self.spark.read.parquet(f"{self.folder}/v{version}")
