"""Near-duplicate vectors by product quantisation (operator 7).

Vectors are scaled to length one; rows with equal labels are compared.  Copies
(equal in all bits after scaling) are one class, and only class representatives
are searched; a class of m copies counts as m.

Index: k-means on a bounded sample gives coarse centroids for all labels
together; each vector belongs to the inverted list of its nearest centroid.  Its
residual is cut into ``subspaces`` parts, each replaced by the nearest of up to
256 codewords (one byte).  The length of what the codes leave over is kept too.

Search: two unit vectors with cosine c lie R = sqrt(2 - 2c) apart.  A list with
centroid z and radius r can hold a partner of x only if |x - z| <= r + R, and
only if x is at most R from the plane halfway between z and its own centroid.
For a partner in a direction unrelated to the lists the step across that plane
is about R / sqrt(dimensions), so lists within ``margin`` x R of the plane are
probed; margin 1 makes the search exact, and the default of 0.5 is 4 standard
deviations at 64 dimensions (recall against brute force in the README and in
the tests).  In a list, tables of the distances between the parts of x - z and
all codewords give |x - q(y)| by look-up; y stays a candidate only if that is at
most R + |y - q(y)|, which loses nothing.  Candidates are reranked by their
exact cosine in double precision.

Work is dealt in blocks: the rows of a list are numbered and cut into slices of
``SLICE`` rows; a task holds one slice as members and one as queries, so neither
a crowded list nor a hot label gathers in one task, and pairs are counted where
they are found: a slice gives off counts per row and a spanning forest of its
links, never all pairs.  A vector's links are counted in its own blocks, so each
ordered pair of representatives is met once.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component, and rows with null labels, link with nothing and are kept;
repeated ids are told apart by their rows only if their vectors differ; vectors
of different lengths don't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.components import components
from lakemill.llm.workspace import least_hashes, save

COSINE = 0.93
SUBSPACES = 8
SAMPLE = 20_000
LIST_ROWS = 400
MOST_LISTS = 4096
SLICE = 1024
MARGIN = 0.5
#: Room for rounding in the bounds; the cosine decides.
SLACK = 1e-6


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest centroid of each row."""
    d2 = (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None]
    best = d2.argmin(1)
    return best, np.sqrt(np.maximum(d2[np.arange(len(x)), best], 0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, _ = _nearest(x, centroids)
        n = np.bincount(best, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


class Index:
    """Coarse centroids and the codewords of each part of the residuals, for one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centroids = kmeans(sample, lists, rng)
        residual = sample - self.centroids[_nearest(sample, self.centroids)[0]]
        self.cuts = np.linspace(0, self.dim, min(parts, self.dim) + 1).astype(int)
        self.words = [kmeans(residual[:, a:b], 256, rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, distance to its centroid, codes, length of the remainder) of each row."""
        cell, away = _nearest(x, self.centroids)
        residual = x - self.centroids[cell]
        codes = np.stack([_nearest(residual[:, a:b], w)[0] for a, b, w in zip(self.cuts, self.cuts[1:], self.words)], axis=1).astype(np.uint8)
        return cell, away, codes, np.sqrt(((residual - self.decode(codes)) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)

    def probes(self, x: np.ndarray, radius: np.ndarray, reach: float, margin: float) -> np.ndarray:
        """Whether each row (first axis) must look into each list (second)."""
        z = self.centroids
        d2 = np.maximum((x**2).sum(1)[:, None] - 2 * x @ z.T + (z**2).sum(1)[None], 0)
        own = d2.argmin(1)
        apart = np.sqrt(np.maximum((z**2).sum(1)[:, None] - 2 * z @ z.T + (z**2).sum(1)[None], 1e-30))
        plane = (d2 - d2.min(1)[:, None]) / (2 * apart[own])
        plane[np.arange(len(x)), own] = 0
        return (np.sqrt(d2) <= radius[None] + reach + SLACK) & (plane <= reach * margin + SLACK)

    def table_distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances between rows and coded members of a list, by table look-up."""
        residual = x - self.centroids[cell]
        d2 = np.zeros((len(x), len(codes)))
        for k, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            part = residual[:, a:b]
            table = (part**2).sum(1)[:, None] - 2 * part @ w.T + (w**2).sum(1)[None]
            d2 += table[:, codes[:, k]]
        return np.sqrt(np.maximum(d2, 0))


def unit(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8")


def _links(index: Index, cell: int, ids: np.ndarray, x: np.ndarray, member_ids: np.ndarray, y: np.ndarray, codes: np.ndarray, rest: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, member) of all links of queries x with members y."""
    reach = np.sqrt(2 - 2 * cosine)
    q, m = np.nonzero(index.table_distances(x, cell, codes) <= reach + rest[None] + SLACK)
    exact = np.einsum("ij,ij->i", x[q], y[m]) if len(q) < 200_000 else np.concatenate([np.einsum("ij,ij->i", x[q[a : a + 200_000]], y[m[a : a + 200_000]]) for a in range(0, len(q), 200_000)])
    linked = (exact >= cosine) & (ids[q] != member_ids[m])
    return q[linked], m[linked]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect the same nodes as all links (a, b) do."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out: tuple[list[int], list[int]] = ([], [])
    for u, v in zip(a.tolist(), b.tolist()):
        ru, rv = find(u), find(v)
        if ru != rv:
            root[max(ru, rv)] = min(ru, rv)
            out[0].append(u)
            out[1].append(v)
    return out


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, unit, ok): unit vectors as little-endian doubles."""
    schema = vectors.schema
    wide = f"id {schema[id_col].dataType.simpleString()}, label {schema[label_col].dataType.simpleString()}, unit binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                x = None
                if v and None not in v:
                    a = np.asarray(v, float)
                    n = float(np.sqrt((a * a).sum())) if np.isfinite(a).all() else 0.0
                    if not np.isfinite(n) or (n == 0 and a.any()):
                        a = a / np.abs(a).max()
                        n = float(np.sqrt((a * a).sum()))
                    if n > 0:
                        x = (a / n + 0.0).astype("<f8").tobytes()
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "unit"])

    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec_col).mapInArrow(run, wide)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", margin: float = MARGIN) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    rows = save(classes(vectors, id_col, vec_col, label_col), "unit-vectors")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull()
    # Two equal copies link: the class key is the label with the vector itself.
    reps = rows.where(usable).groupBy("label", "unit").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least"))
    reps = save(reps.withColumn("rep", F.xxhash64("label", "unit")).withColumn("dim", F.octet_length("unit")), "classes")
    dims = [r.dim for r in reps.select("dim").distinct().collect()]
    total = reps.count()
    # The sample is bounded; it only shapes the lists and codes.
    indexes = {}
    for dim in dims:
        of = reps.where(F.col("dim") == dim)
        sample = [unit(bytes(r.unit)) for r in least_hashes(of.select("unit", "rep"), F.col("rep"), SAMPLE, of.count()).collect()]
        indexes[dim] = Index(np.stack(sample), min(MOST_LISTS, total // LIST_ROWS + 1), SUBSPACES)
    index_sent = spark.sparkContext.broadcast(indexes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dim = [bytes(x) for x in batch.column(2).to_pylist()], np.asarray(batch.column(4).to_pylist())
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.stack([unit(raw[k]) for k in at])
                cell, away, codes, rest = index_sent.value[int(d)].encode(x)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], names=[*batch.schema.names, "cell", "away", "codes", "rest"])

    kind = rows.schema["label"].dataType.simpleString()
    slim = reps.select("label", "rep", "unit", "m", "dim")
    coded = save(slim.mapInArrow(assign, f"label {kind}, rep long, unit binary, m long, dim int, cell int, away double, codes binary, rest double"), "coded")
    # A list's rows of one label are numbered bucket by bucket, and cut into slices.
    sizes = coded.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    lists = save(sizes.withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int")), "lists")
    member = coded.join(lists.select("label", "dim", "cell", "slices"), ["label", "dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("slices")).cast("int"))
    member = save(member, "members")
    # The radius of a list is the largest over all labels: lists x dimensions rows.
    radius = {d: np.zeros(len(i.centroids)) for d, i in indexes.items()}
    for r in lists.groupBy("dim", "cell").agg(F.max("radius").alias("r")).collect():
        radius[r.dim][r.cell] = r.r
    radius_sent = spark.sparkContext.broadcast(radius)
    reach = float(np.sqrt(2 - 2 * cosine))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dim = [bytes(x) for x in batch.column(2).to_pylist()], np.asarray(batch.column(4).to_pylist())
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.stack([unit(raw[k]) for k in at])
                q, cell = np.nonzero(index_sent.value[int(d)].probes(x, radius_sent.value[int(d)], reach, margin))
                for a in range(0, len(q), 20_000):
                    part = batch.take(pa.array(at[q[a : a + 20_000]]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[a : a + 20_000], pa.int32())], names=[*batch.schema.names, "cell"])

    asked = slim.mapInArrow(probe, f"label {kind}, rep long, unit binary, m long, dim int, cell int")
    # A query meets every slice of the list; queries of a slice are cut in turn.
    here = ["label", "dim", "cell"]
    asked = asked.join(lists.select(*here, "slices"), here).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asked = save(asked.select(*here, "slice", "rep", "unit", "m"), "queries")
    pieces = save(asked.groupBy(*here, "slice").agg(F.ceil(F.count(F.lit(1)) / (4 * SLICE)).cast("int").alias("pieces")), "query-pieces")
    block = F.xxhash64("label", "dim", "cell", "slice", "piece").alias("block")
    left = asked.join(pieces, [*here, "slice"]).withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("pieces")).cast("int"))
    right = member.join(pieces, [*here, "slice"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    none_b, none_d = F.lit(None).cast("binary"), F.lit(None).cast("double")
    both = left.select(block, F.lit(0).alias("side"), *here, "slice", "piece", "rep", "unit", "m", none_b.alias("codes"), none_d.alias("rest"))
    both = both.unionByName(right.select(block, F.lit(1).alias("side"), *here, "slice", "piece", "rep", "unit", "m", "codes", "rest"))

    def compare(batches: Iterator[pa.Table] | pa.Table) -> pa.Table:
        t = batches
        side = t.column("side").to_numpy()
        take = lambda name, s: t.column(name).filter(pa.array(side == s))
        u, v, n = [], [], []
        if (side == 0).any() and (side == 1).any():
            dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
            x, y = (np.stack([unit(bytes(b)) for b in take("unit", s).to_pylist()]) for s in (0, 1))
            qi, mi = take("rep", 0).to_numpy(), take("rep", 1).to_numpy()
            mm = take("m", 1).to_numpy()
            codes = np.stack([np.frombuffer(bytes(b), np.uint8) for b in take("codes", 1).to_pylist()])
            q, m = _links(index_sent.value[dim], cell, qi, x, mi, y, codes, take("rest", 1).to_numpy(), cosine)
            found, inv = np.unique(q, return_inverse=True)
            a, b = _forest(qi[q], mi[m])
            u = [*qi[found].tolist(), *a]
            v = [*[None] * len(found), *b]
            n = [*np.bincount(inv, mm[m], len(found)).astype(np.int64).tolist(), *[0] * len(a)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    found = save(both.groupBy("block").applyInArrow(compare, "u long, v long, n long"), "vector-links")
    linked = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    label_of = components(found.where("v is not null").select("u", "v"))
    least = label_of.join(reps.select(F.col("rep").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("wide"))
    wide = label_of.join(least, "label").select(F.col("node").alias("rep"), "wide")
    groups = reps.join(linked.withColumnRenamed("u", "rep"), "rep", "left").join(wide, "rep", "left")
    groups = save(groups.select("label", "unit", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("wide", "least").alias("component_id")), "vector-groups")
    out = rows.join(groups, ["label", "unit"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def duckdb_sql(cosine: float = COSINE) -> str:
    """All pairs of equal labels by brute force in DuckDB's SQL, for finite vectors without nulls in them."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)
"""
