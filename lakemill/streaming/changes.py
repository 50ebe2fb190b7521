"""Change logs, conflict policies, branch diff and merge, and streams of changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _changed(columns: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _met(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = None
    for k in keys:
        one = F.col(f"o.{k}") == F.col(f"n.{k}")
        same = one if same is None else same & one
    return old.withColumn("__in", F.lit(1)).alias("o").join(new.withColumn("__in", F.lit(1)).alias("n"), same, "full")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, op (added, removed, changed), and the row before and after: one join on the keys."""
    rest = [c for c in old.columns if c not in keys]
    op = F.when(F.col("o.__in").isNull(), "added").when(F.col("n.__in").isNull(), "removed").when(_changed(rest, "o", "n"), "changed")
    side = lambda s: F.when(F.col(f"{s}.__in").isNotNull(), F.struct(*[F.col(f"{s}.{c}").alias(c) for c in old.columns]))
    out = _met(old, new, keys).select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], op.alias("op"), side("o").alias("before"), side("n").alias("after"))
    return out.where("op is not null")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of two branches of base: keys changed differently in both conflict and keep ours."""
    a = diff(base, ours, keys).select(*keys, F.col("op").alias("our_op"), F.col("after").alias("our"))
    b = diff(base, theirs, keys).select(*keys, F.col("op").alias("their_op"), F.col("after").alias("their"))
    both = a.join(b, list(keys), "full")
    clash = F.col("our_op").isNotNull() & F.col("their_op").isNotNull() & ~F.col("our").eqNullSafe(F.col("their"))
    conflicts = both.where(clash).select(*keys, "our_op", "their_op")
    apply_ = both.where(F.col("our_op").isNull()).select(*keys, F.col("their_op").alias("__op"), F.col("their").alias("__row"))
    met = ours.join(apply_, list(keys), "full")
    merged = met.where(F.coalesce(F.col("__op") != "removed", F.lit(True)))
    return merged.select(*[c if c in keys else F.when(F.col("__op").isNotNull(), F.col(f"__row.{c}")).otherwise(F.col(c)).alias(c) for c in ours.columns]), conflicts


def apply_changes(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table after a change log (op: insert, update, delete; and the row's columns).

    Of each key's changes the last by order wins: last writer wins with
    (time, sequence), or origin priority with the priority first.
    """
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    last = changes.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    kept = table.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where("op <> 'delete'").select(*table.columns))


def conflicting_keys(changes: DataFrame, keys: Sequence[str], origin: str) -> DataFrame:
    """Keys that more than one origin changed: the stop policy refuses these."""
    return changes.groupBy(*keys).agg(F.count_distinct(origin).alias("origins")).where("origins > 1")


def change_stream(spark: SparkSession, folder: str, schema: str, where: Column | None = None, files_per_batch: int = 64, names: str = "*") -> DataFrame:
    """A stream of change rows from Parquet files (of names that match) as they land; where is the watched range."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)
    return stream if where is None else stream.where(where)


def watch(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Call on_batch for each batch of changes until all that is there is seen."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window and kind; late data up to the watermark is counted."""
    w = F.window(F.col(time).cast("timestamp"), length)
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
