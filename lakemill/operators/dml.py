"""DML as functions from table versions to table versions, with constraints.

Each function returns the table's new version and the affected rows (RETURNING).
Nothing is run until either is used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Change:
    table: DataFrame
    affected: DataFrame

    def returning(self, *columns) -> DataFrame:
        return self.affected.select(*(columns or ["*"]))


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Change:
    """INSERT: missing columns get their default or null."""
    have = {c.lower() for c in rows.columns}
    new = rows.select(*[(F.col(f.name) if f.name.lower() in have else (defaults or {}).get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    return Change(table.unionByName(new), new)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, where: Column | None = None) -> Change:
    """INSERT ... ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET update [WHERE where].

    Expressions name the old row's columns as they are and the new row's as
    excluded_<name>.  Keys with nulls never conflict.  Of rows with one new key
    the least stays.
    """
    columns = table.columns
    w = W.partitionBy(*keys).orderBy(*[c for c in columns if c not in keys])
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    new = rows.select(*columns).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | null_key).drop("__n")
    renamed = new.select(*[F.col(c).alias(f"excluded_{c}") for c in columns], F.lit(True).alias("__new"))
    same = None
    for k in keys:
        one = F.col(k) == F.col(f"excluded_{k}")
        same = one if same is None else same & one
    met = table.withColumn("__old", F.lit(True)).join(renamed, same, "full")
    old, fresh = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    change = old & fresh & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)) if update is not None else F.lit(False)
    values = [F.when(~old, F.col(f"excluded_{c}")).when(change, update[c] if update and c in update else F.col(c)).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) for c in columns]
    out = met.select(*values, (~old | change).alias("__affected"))
    return Change(out.drop("__affected"), out.where("__affected").drop("__affected"))


def update(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> Change:
    """UPDATE SET assign WHERE where; all expressions see the old row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    marked = table.withColumn("__hit", hit)
    out = marked.select(*[F.when(F.col("__hit"), assign[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in assign else F.col(f.name) for f in table.schema.fields], "__hit")
    return Change(out.drop("__hit"), out.where("__hit").drop("__hit"))


def delete(table: DataFrame, where: Column | None = None) -> Change:
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return Change(table.where(~hit), table.where(hit))


def truncate(table: DataFrame) -> Change:
    return Change(table.limit(0), table)


@dataclass
class Constraints:
    """What a table's rows must satisfy; violations() are its counterexamples."""

    primary_key: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    checks: dict[str, Column] = field(default_factory=dict)

    def violations(self, table: DataFrame) -> DataFrame:
        """(constraint, key, n): a check fails only where it is false, and nulls are never equal."""
        found = table.select(F.lit("").alias("constraint"), F.lit("").alias("key"), F.lit(0).cast("long").alias("n")).limit(0)
        for keys in [self.primary_key, *self.unique]:
            if keys:
                full = table.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1")
                found = found.unionAll(full.select(F.lit(f"unique({', '.join(keys)})"), F.to_json(F.struct(*keys)), "count"))
        for c in {*self.not_null, *self.primary_key}:
            found = found.unionAll(table.where(F.col(c).isNull()).groupBy().count().where("count > 0").select(F.lit(f"not null({c})"), F.lit(""), "count"))
        for name, check in self.checks.items():
            found = found.unionAll(table.where(~check).groupBy().count().where("count > 0").select(F.lit(f"check({name})"), F.lit(""), "count"))
        return found


def foreign_key_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key isn't null and has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__pk")), F.col(child_key) == F.col("__pk"), "left_anti")


def delete_parent(parent: DataFrame, child: DataFrame, where: Column, parent_key: str, child_key: str, action: str = "no action") -> tuple[DataFrame, DataFrame]:
    """(parent, child) after a delete, with the foreign key's action on the children."""
    gone = parent.where(F.coalesce(where, F.lit(False))).select(F.col(parent_key).alias("__pk"))
    rest = parent.where(~F.coalesce(where, F.lit(False)))
    same = F.col(child_key) == F.col("__pk")
    if action == "cascade":
        return rest, child.join(gone, same, "left_anti")
    if action == "set null":
        met = child.join(gone.distinct(), same, "left")
        return rest, met.withColumn(child_key, F.when(F.col("__pk").isNull(), F.col(child_key))).select(*child.columns)
    if not child.join(gone, same, "left_semi").isEmpty():
        raise ValueError("rows are still referenced")
    return rest, child


def with_generated(table: DataFrame, **columns: Column) -> DataFrame:
    """Stored or virtual generated columns; each sees the plain columns only."""
    return table.select("*", *[c.alias(n) for n, c in columns.items()])


class Triggers:
    """AFTER and INSTEAD OF callbacks on a table's changes."""

    def __init__(self) -> None:
        self.after: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}
        self.instead: dict[str, Callable[[DataFrame], Change]] = {}

    def on(self, event: str, action: Callable[[DataFrame], DataFrame]) -> None:
        self.after.setdefault(event, []).append(action)

    def instead_of(self, event: str, action: Callable[[DataFrame], Change]) -> None:
        self.instead[event] = action

    def fire(self, event: str, change: Change) -> list[DataFrame]:
        """The rows that each trigger's action gives for the affected rows."""
        if event in self.instead:
            change = self.instead[event](change.affected)
        return [action(change.affected) for action in self.after.get(event, [])]
