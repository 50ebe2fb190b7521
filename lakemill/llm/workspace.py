"""Shared storage and small helpers that the operators of this subpackage use.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` and are
read back, which cuts lineage and survives the loss of executors.  Only where
that setting is absent (a local test session) a private folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}

#: Rows in one Arrow batch. Long texts make a batch large, so it is kept small.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lakemill-")
        spark.conf.set("spark.checkpoint.dir", f"file://{_LOCAL[app]}")
    return f"file://{_LOCAL[app]}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakemill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch by bounding its rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def least_hashes(rows: DataFrame, h: Column, n: int, total: int) -> DataFrame:
    """At most n of about total rows, those of least hash; fewer only if total was too high.

    A limit on the hash, set from the total, leaves few more than n rows before
    the sort, so that all tasks together send about n rows, not n each.
    """
    share = (n + 6 * n**0.5 + 50) / max(1, total)
    if share < 1:
        rows = rows.where(h <= F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(h).limit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8; a null is an empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def fold_of(doc_id: object, parts: int) -> int:
    """The same as fold(), for one value."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def words(text: bytes) -> list[bytes]:
    """A-Z in lower case, split at the ASCII white space 0x20 and 0x09 to 0x0D."""
    return text.lower().split()
