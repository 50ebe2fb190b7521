"""Row policies and column masks as views over a table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Policies:
    """Policies are ANDed and a null hides a row; masks see the original row."""

    rows: list[Column] = field(default_factory=list)
    masks: dict[str, Column] = field(default_factory=dict)

    def view(self, table: DataFrame) -> DataFrame:
        seen = table.where(reduce(lambda a, b: a & b, self.rows)) if self.rows else table
        return seen.select(*[self.masks[f.name].cast(f.dataType).alias(f.name) if f.name in self.masks else F.col(f.name) for f in table.schema.fields])


def set_audit_context(spark, **context: str) -> None:
    for key, value in context.items():
        spark.conf.set(f"lakemill.audit.{key}", value)


def audit_context(spark, key: str) -> Column:
    """The session's value as a literal, null if unset."""
    return F.lit(spark.conf.get(f"lakemill.audit.{key}", None))
