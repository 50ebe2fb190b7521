"""Sharding by k-d tree partitioning (operator 3).

A node of the tree that stands for k shards is split so that its left child
stands for k // 2 of them: at the weighted median (weight: size in bytes; for
odd k the weighted k // 2 : k quantile) along the metadata dimension that is
widest in the node, measured against the whole table's width.  Splits go on
until each leaf is one shard of the target bytes.

The quantiles are exact and distributed: all nodes of a level share one pass
that sums the bytes of each of ``bins`` intervals, then the interval with the
target is refined, until what it holds is under ``tolerance`` of a shard.  Rows
that tie in the dimension are ordered by the hash of their text, so equal texts
stay together; a group of equal texts is cut (by id) only if it holds more than
the tolerance and the target falls inside it, so a group with a third of all
rows doesn't unbalance the shards.  Only sums for at most nodes x bins
intervals reach the driver.

A slot is a row's place in its shard.  Shards are cut into buckets by hash, of
about ``bucket_rows`` rows each; a row's place in its bucket is added to the
rows of the buckets before, so no task ever sorts a whole shard.

Defined results: a null text has size 16 and the crc of an empty text; null
dimensions count as 0 and null ids as the least id; rows equal in text and id
aren't cut apart; fewer rows than shards leave shards empty; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.workspace import save, text_bytes

BINS = 8192
TOLERANCE = 0.005
BUCKET_ROWS = 50_000


@dataclass
class Node:
    """A subtree over shards first .. first + shards - 1."""

    id: int
    first: int
    shards: int
    dim: int | None = None
    cut: tuple[int, int, int] | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Search:
    """The quantile search of one node: equal to fixed in the first keys, then lo <= key <= hi."""

    node: Node
    target: float
    left: float
    lo: int
    hi: int
    fixed: list[int] = field(default_factory=list)


def size_of(text: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 16).cast("long")


def text_dimensions(text: str = "text") -> dict[str, Column]:
    """Metadata of the text alone, as integers, so that equal texts are equal in all."""
    t = F.coalesce(F.col(text), F.lit(""))
    octets = F.greatest(F.octet_length(t), F.lit(1))
    return {
        "log_size": F.round(F.log2(octets.cast("double")) * 4096).cast("long"),
        "chars_per_byte": F.round(F.length(t) / octets * 65536).cast("long"),
        "spaces_per_byte": F.round((F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / octets * 65536).cast("long"),
    }


@dataclass
class Router:
    """Sends rows down the tree, one split level after the other, in numpy."""

    levels: list[dict[str, np.ndarray]] = field(default_factory=list)

    def add(self, nodes: list[Node], made: int) -> None:
        """Take up the splits of one level; made: nodes so far, under two for each shard."""
        table = {k: np.zeros(made, np.int64) for k in ("dim", "c0", "c1", "c2")}
        table |= {k: np.arange(made) for k in ("below", "above")}
        for n in nodes:
            values = (n.dim, *n.cut, n.children[0].id, n.children[1].id)
            for k, v in zip(("dim", "c0", "c1", "c2", "below", "above"), values):
                table[k][n.id] = v
        self.levels.append(table)

    def nodes(self, dims: np.ndarray, th: np.ndarray, order: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(th), np.int64), np.arange(len(th))
        for t in self.levels:
            a, c0, c1, c2 = dims[every, t["dim"][node]], t["c0"][node], t["c1"][node], t["c2"][node]
            left = (a < c0) | ((a == c0) & ((th < c1) | ((th == c1) & (order <= c2))))
            node = np.where(left, t["below"][node], t["above"][node])
        return node


def _arrays(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size, th, order, *d = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3 + dims))
    return size, th, order, np.stack(d, axis=1) if d else np.zeros((len(th), 1), np.int64)


def _extents(rows: DataFrame, router: Router, dims: int) -> dict[int, tuple[int, list[int], list[int]]]:
    """node: (bytes, least, greatest of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, th, order, d = _arrays(batch, dims)
            node = router.nodes(d, th, order)
            for k in np.unique(node):
                at = node == k
                ends = [*d[at].min(axis=0).tolist(), *d[at].max(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (int(k), int(size[at].sum()), *ends)], names=names)

    n = max(1, dims)
    names = ["node", "size", *(f"lo{k}" for k in range(n)), *(f"hi{k}" for k in range(n))]
    found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("node")
    ends = [f(f"{a}{k}").alias(f"{a}{k}") for a, f in (("lo", F.min), ("hi", F.max)) for k in range(n)]
    return {r[0]: (r[1], list(r[2 : 2 + n]), list(r[2 + n :])) for r in found.agg(F.sum("size").alias("size"), *ends).collect()}


def _histogram(rows: DataFrame, router: Router, dims: int, asked: dict[int, tuple[int, list[int], int, int, int]], bins: int):
    """(node, slot, n) with the bytes of each interval; asked: node: (dim, fixed, lo, hi, width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(bins + 1, np.int64) for k in asked}
        for batch in batches:
            size, th, order, d = _arrays(batch, dims)
            node = router.nodes(d, th, order)
            for k, (dim, fixed, lo, hi, width) in asked.items():
                at = node == k
                keys = [d[at, dim], th[at], order[at]]
                key, inside = keys[len(fixed)], np.ones(int(at.sum()), bool)
                for x, v in zip(keys, fixed):
                    inside &= x == v
                inside &= (key >= lo) & (key <= hi)
                np.add.at(sums[k], (key[inside] - lo) // width, size[at][inside])
        for k, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int64()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["node", "slot", "n"])

    return rows.mapInArrow(run, "node long, slot long, n long").groupBy("node", "slot").agg(F.sum("n").alias("n")).collect()


def _quantiles(rows: DataFrame, router: Router, dims: int, searches: list[Search], tolerance: float, bins: int) -> None:
    """Set each searched node's cut."""
    top = (1 << 62) - 1
    while searches:
        width = {s.node.id: max(1, -(-(s.hi - s.lo + 1) // bins)) for s in searches}
        asked = {s.node.id: (s.node.dim, s.fixed, s.lo, s.hi, width[s.node.id]) for s in searches}
        sums: dict[int, dict[int, int]] = {}
        for r in _histogram(rows, router, dims, asked, bins):
            sums.setdefault(r.node, {})[r.slot] = r.n
        open_: list[Search] = []
        for s in searches:
            w, at = width[s.node.id], s.left
            cut = s.lo - 1
            for k, n in sorted(sums.get(s.node.id, {}).items()):
                if at + n <= s.target:
                    at, cut = at + n, s.lo + (k + 1) * w - 1
                    continue
                if n <= tolerance:
                    if s.target - at > at + n - s.target:
                        cut = s.lo + (k + 1) * w - 1
                elif w > 1:
                    open_.append(Search(s.node, s.target, at, s.lo + k * w, min(s.hi, s.lo + (k + 1) * w - 1), s.fixed))
                    cut = None
                elif len(s.fixed) < 2:
                    lo, hi = (0, top) if not s.fixed else (-(1 << 61), (1 << 61) - 1)
                    open_.append(Search(s.node, s.target, at, lo, hi, [*s.fixed, s.lo + k]))
                    cut = None
                elif s.target - at > at + n - s.target:
                    cut = s.lo + k
                break
            if cut is not None:
                # All of the smaller keys, whatever the keys after them.
                s.node.cut = tuple([*s.fixed, cut, *[top] * (2 - len(s.fixed))])
        searches = open_


def kd_tree(rows: DataFrame, dims: int, shards: int, tolerance: float = TOLERANCE, bins: int = BINS) -> tuple[Router, list[int]]:
    """The tree's router, and the shard of each node that is a leaf (else -1).

    rows: size, th (0 to 2^62 - 1), ord (-2^61 to 2^61 - 1), d0, d1 ... (integers).
    """
    router, level, made, leaves = Router(), [Node(0, 0, shards)], 1, []
    wide, limit = None, 0.0
    while True:
        leaves += [n for n in level if n.shards == 1]
        level = [n for n in level if n.shards > 1]
        if not level:
            break
        found = _extents(rows, router, dims)
        if wide is None:
            size, lo, hi = found.get(0, (0, [0], [0]))
            wide, limit = [max(1, b - a) for a, b in zip(lo, hi)], tolerance * size / shards
        searches = []
        for n in level:
            n.dim, n.cut = 0, (0, 0, 0)
            if n.id in found:
                size, lo, hi = found[n.id]
                share = [(b - a) / w for a, b, w in zip(lo, hi, wide)]
                n.dim = share.index(max(share))
                searches.append(Search(n, size * (n.shards // 2) / n.shards, 0, lo[n.dim], hi[n.dim]))
        _quantiles(rows, router, dims, searches, limit, bins)
        below = []
        for n in level:
            half = n.shards // 2
            n.children = [Node(made, n.first, half), Node(made + 1, n.first + half, n.shards - half)]
            made += 2
            below += n.children
        router.add(level, made)
        level = below
    first = {n.id: n.first for n in leaves}
    return router, [first.get(k, -1) for k in range(made)]


def kd_shards(docs: DataFrame, shards: int, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row."""
    dims = text_dimensions(text_col) if dims is None else dims
    number = F.coalesce(F.col(id_col), F.lit(-(1 << 61))) if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else F.shiftrightunsigned(F.xxhash64(id_col), 3)
    slim = docs.select(
        size_of(text_col).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2).alias("th"),
        number.cast("long").alias("ord"),
        *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"d{k}") for k, c in enumerate(dims.values())],
        F.crc32(text_bytes(text_col)).alias("crc"),
        F.col(id_col).alias("id"),
    )
    slim = save(slim, "sizes")
    n_dims = len(dims)
    router, shard_of = kd_tree(slim, n_dims, shards)
    buckets = max(1, -(-slim.count() // (shards * bucket_rows)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = np.array(shard_of, np.int32)
        for batch in batches:
            size, th, order, d = _arrays(batch, n_dims)
            shard = leaf[router.nodes(d, th, order)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3 + n_dims), batch.column(4 + n_dims), pa.array(shard, pa.int32())], names=["size", "th", "ord", "crc", "id", "shard"])

    placed = slim.mapInArrow(run, f"size long, th long, ord long, crc long, id {kind}, shard int")
    placed = save(placed.withColumn("bucket", F.pmod(F.xxhash64("ord", "th"), F.lit(4 * buckets)).cast("int")), "placed")
    counts = save(placed.groupBy("shard", "bucket").count(), "bucket-rows")
    before = F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "bucket", before.alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("ord", "th")) - 1
    out = placed.withColumn("within", within).join(counts, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
