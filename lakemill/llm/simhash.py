"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4).

Fingerprint: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower
case; every run of ``shingle`` words, repeats included, is hashed by XXH64
(seed 42); a bit is 1 if it is set in more than half of the hashes.  A text of
fewer words has one shingle, its whole word sequence; a text without words has
fingerprint zero.

Search: a random-looking map m gives each of the 64 bit positions a vector of
r + 1 bits.  Table v (each non-zero vector of r + 1 bits) keeps the positions i
for which the inner product of m(i) and v is 1.  For any r positions some v is
orthogonal to all of their vectors, so two fingerprints that differ in at most
r positions agree on all that table v keeps: no pair is missed.  A bucket of
more than ``BUCKET`` fingerprints isn't compared pair by pair: its members can
differ only in the positions that its mask drops, so a further covering with
another map splits it again, as often as it takes.  Half of the free positions
go at each level, so a last bucket can't hold many distinct fingerprints.

near_duplicates() is the filter for shingle similarity.  Its candidates are the
components of the same fingerprints and search.  SimHash only estimates angles,
which a cut or an added block changes more than its share of shingles, so what
lies past the radius is added by MinHash over the shingles that are compared: each
of ``BANDS`` bands hashes ``ROWS`` minima of the set, and texts that share a band
are candidates too.  At Jaccard similarity s both together miss a pair with
probability (1 - s**ROWS)**BANDS at most, under 0.0001 at 0.8 and less above,
whatever the edits.  A pair counts only if the exact similarity of the sets of
``verify``-word shingles is ``similarity`` or more.

Copies share a fingerprint and are represented by it in the search; the number
of documents behind a fingerprint never matters.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows get the same component; documents whose ids are all null
get a null component; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.components import components
from lakemill.llm.runs import shingle_kinds
from lakemill.llm.workspace import save, small_batches, text_bytes, words

BUCKET = 48
MAX_LEVELS = 8
#: Bands of a text's MinHash, and minima in each.
BANDS, ROWS = 24, 5
#: 64-bit words of a text's sketch.
SKETCH = 8
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 14


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of words, as unsigned 64-bit integers."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: len(found) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], 42) for i, j in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


_FACTOR, _TERM = np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_FACTOR |= np.uint32(1)


def band_keys(kinds: np.ndarray) -> list[int]:
    """The hash of each band of minima of a text's distinct shingles."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    short = (kinds >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _CHUNK >> 3):
        # The shingles' hashes are random, so a product and a mask order them anew in each row.
        least = np.minimum(least, ((short[at : at + (_CHUNK >> 3)] * _FACTOR) ^ _TERM).min(axis=1))
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(least.reshape(BANDS, ROWS))]


def sketch(kinds: np.ndarray) -> np.ndarray:
    """Bits that tell whether an even or odd number of a text's shingles fall on them.

    Shingles of both texts leave no trace in the exclusive or of two sketches, so
    it has no more bits than there are shingles of just one of them.
    """
    odd = np.bincount((kinds % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def covering_masks(radius: int, level: int, bits: int = 64) -> list[int]:
    """The kept positions of each table, as signed 64-bit integers.

    Each vector of radius + 1 bits goes to nearly equally many positions; the
    level chooses which, so that the masks of different levels are unrelated.
    """
    vectors = [k % (1 << radius + 1) for k in range(bits)]
    random.Random(1000 + level).shuffle(vectors)
    masks = []
    for v in range(1, 1 << radius + 1):
        kept = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _tables(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each (mask, fp) once for every further mask, with the bits that are kept."""
    more = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    return rows.select(more.alias("m"), "mask", "fp").select(F.col("mask").bitwiseOR(F.col("m")).alias("mask"), "fp").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _pairs_within(group: Column, radius: int) -> Column:
    """The near pairs of a short array of distinct fingerprints."""
    near = F.transform(group, lambda x: F.transform(F.filter(group, lambda y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= radius)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return F.flatten(near)


def near_groups(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """g: short arrays of distinct fingerprints, such that each pair at radius or fewer bits shares one."""
    rows, found = distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    for level in range(MAX_LEVELS):
        rows = _tables(rows, covering_masks(radius, level))
        rows = rows.distinct() if level else rows
        keys = save(rows.groupBy("mask", "key").count().where("count > 1"), "buckets")
        last = level == MAX_LEVELS - 1
        met = rows.join(keys, ["mask", "key"])
        small = met if last else met.where(F.col("count") <= BUCKET)
        found.append(save(small.groupBy("mask", "key").agg(F.sort_array(F.collect_set("fp")).alias("g")).select("g"), "groups"))
        if last or keys.where(F.col("count") > BUCKET).isEmpty():
            break
        rows = save(met.where(F.col("count") > BUCKET).select("mask", "fp"), "crowded")
    return reduce(DataFrame.union, found)


def near_pairs(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints at radius or fewer bits."""
    groups = near_groups(distinct, radius)
    return groups.select(F.explode(_pairs_within(F.col("g"), radius)).alias("p")).select("p.a", "p.b").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of each row; component_id is the least id reachable."""
    prints = save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    reps = save(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    labels = components(near_pairs(reps.select("fp"), radius))
    linked = labels.join(reps, labels["node"] == reps["fp"])
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of_linked = labels.join(least, "label").select(F.col("node").alias("fp"), F.col("component_id").alias("wide"))
    classes = reps.join(of_linked, "fp", "left").select("fp", F.coalesce("wide", "least").alias("component_id"))
    return prints.join(save(classes, "membership"), "fp").select(id_col, "fp", "component_id")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets of shingles; those of two texts without words are alike."""
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame, verify: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; texts has one row for each node.

    The joins are the same at every size: a small input must not flip to a
    broadcast of texts that a large one can't have.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = [], {}
            sides = []
            for k in (0, 1):
                for node, text in zip(batch.column(k).to_pylist(), batch.column(k + 2).to_pylist()):
                    if node not in places:
                        places[node] = len(texts)
                        texts.append(text)
                sides.append([places[node] for node in batch.column(k).to_pylist()])
            kinds = shingle_kinds(texts, verify)
            ok = [jaccard(kinds[x], kinds[y]) >= similarity for x, y in zip(*sides)]
            part = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return save(sides.select("a", "b", "ta", "tb").mapInArrow(judge, "a long, b long"), "similar")


def _apart(bands: DataFrame, links: DataFrame) -> DataFrame:
    """The bands, with the part of each node, of the keys whose nodes the links leave in several parts."""
    named = bands.join(components(links).withColumnRenamed("label", "part"), "node", "left").select(*bands.columns, F.coalesce("part", "node").alias("part"))
    named = save(named, "parts")
    apart = save(named.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key"), "apart")
    return save(named.join(apart.hint("merge"), "key", "left_semi"), "open")


def _rarest(nodes: DataFrame, texts: DataFrame, verify: int, similarity: float) -> DataFrame:
    """(key, node, n, sketch, rank, short): the shingles, rarest among these nodes first, of which two similar texts share one.

    short: the shingle is among those few that the text with fewer shingles, or
    as many, must share with any of the other's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [k.view(np.int64) for k in shingle_kinds(batch.column(1).to_pylist(), verify)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, kinds), pa.int64()), pa.array([sketch(k.view(np.uint64)) for k in kinds], pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int64()))], names=["node", "n", "sketch", "kinds"])

    asked = texts.join(save(nodes, "open-nodes").hint("merge"), "node").select("node", "text")
    asked = save(asked.mapInArrow(run, "node long, n long, sketch array<long>, kinds array<long>"), "open-shingles")
    flat = asked.select("node", "n", F.explode("kinds").alias("key"))
    # A shingle of one text meets nothing, but counts among its rarest: those that aren't sent come first.
    counts = save(flat.groupBy("key").count().where("count > 1"), "shingle-counts")
    of = W.partitionBy("node")
    rank = F.col("n") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("count", "key"))
    ranked = flat.join(counts.hint("merge"), "key").withColumn("rank", rank)
    within = lambda share: F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-6)) + 1
    # Of sizes m <= n a similar pair shares s (m + n) / (1 + s) shingles, so 2 s m / (1 + s) at least.
    short = within(2 * similarity / (1 + similarity)).alias("short")
    rarest = ranked.where(within(similarity)).select("key", "node", "n", "rank", short)
    return save(rarest.join(asked.select("node", "sketch").hint("merge"), "node").select("key", "node", "n", "sketch", "rank", "short"), "rarest")


def _similar(bands: DataFrame, texts: DataFrame, verify: int, similarity: float) -> DataFrame:
    """Verified links (a, b) of texts that connect all that the candidate pairs connect.

    Each text that shares a band, or a component of fingerprints, which is a band
    like any other here, is a node of its own.  First all texts of a band are
    compared with its least one.  Texts of bands that the links leave apart
    meet again where they share one of their rarest shingles: each text is
    compared with one text of every other part there, and what is still apart
    after that pair by pair.  Of n shingles the n - ceil(similarity n) + 1
    rarest must hold one that a similar text has among its own, so texts that
    only share a common passage don't meet, and no pair is lost; nor do texts whose
    sketches prove that too many shingles are in one of them only.  A pair goes
    unverified only where its ends are connected without it, or where its
    shingles rule the similarity out.
    """
    fits = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - F.lit(1e-6)
    ends = lambda df: df.where(fits(F.col("n"), F.col("o"))).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    least = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("r")).select("key", F.col("r.node").alias("other"), F.col("r.n").alias("o"))
    links = _verified(save(ends(bands.join(least, "key").where("node <> other")), "candidates"), texts, verify, similarity)
    bands = _rarest(_apart(bands, links).select("node").distinct(), texts, verify, similarity)
    for last in (False, True):
        open_ = _apart(bands, links)
        to = open_.where("short")
        if not last:
            to = to.groupBy("key", "part").agg(F.min(F.struct("rank", "node", "n", "sketch")).alias("r")).select("key", "part", "r.rank", "r.node", "r.n", "r.sketch")
        to = to.select("key", F.col("part").alias("q"), F.col("node").alias("other"), F.col("n").alias("o"), F.col("rank").alias("at"), F.col("sketch").alias("others"))
        pairs = open_.join(to.hint("merge"), "key").where("part <> q AND n >= o" if last else "part <> q")
        # A pair can't share more than follows its first shared shingle on either side.
        most = F.least(F.col("n") - F.col("rank"), F.col("o") - F.col("at")) + 1
        pairs = pairs.where(most * (1 + similarity) >= F.lit(similarity) * (F.col("n") + F.col("o")) - F.lit(1e-6))
        # Nor can it be similar if its sketches show more shingles of one text alone than that allows.
        alone = reduce(lambda x, y: x + y, [F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("others")[k])) for k in range(SKETCH)])
        pairs = pairs.where(alone * (1 + similarity) <= F.lit(1 - similarity) * (F.col("n") + F.col("o")) + F.lit(1e-6))
        links = save(links.unionAll(_verified(save(ends(pairs), "candidates"), texts, verify, similarity)), "similar")
    return links


def _fingerprint_bands(prints: DataFrame, radius: int) -> DataFrame:
    """(node, n, key): the component that each text's fingerprint is in, by links of radius or fewer bits."""
    labels = components(near_pairs(prints.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    return prints.select("node", "n", "fp").join(labels, "fp", "left").select("node", "n", F.coalesce("label", "fp").alias("key"))


def near_duplicates(docs: DataFrame, verify: int = 5, similarity: float = 0.8, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates: that of the least id.

    Texts equal in all bytes are one group without any search; distinct texts
    are linked by verified candidates, and groups are connected components.  Of
    rows that repeat an id and a text one stays.  All columns are returned.
    shingle and radius are those of the fingerprints.
    """
    small_batches(docs.sparkSession)
    rows = save(docs.withColumn("__sh_row", F.monotonically_increasing_id()), "rows")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Copies of a batch are read once.
            places: dict[bytes, int] = {}
            which = pa.array([places.setdefault(d, len(places)) for d in batch.column(2).to_pylist()], pa.int64())
            texts = dict(zip(which.to_pylist(), batch.column(3).to_pylist()))
            found = [texts[k] for k in range(len(places))]
            kinds, fp = shingle_kinds(found, verify), [fingerprint(t, shingle) for t in found]
            columns = [pa.array(map(len, kinds), pa.int64()), pa.array(fp, pa.int64()), pa.array(map(band_keys, kinds), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(c.take(which) for c in columns)], names=["row", "id", "digest", "n", "fp", "keys"])

    # Texts stay where they are until it is known which are candidates; a row's number is its text's node.
    asked = rows.select(F.col("__sh_row").alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text_bytes(text_col), 256)).alias("digest"), text_bytes(text_col).alias("text"))
    prints = asked.mapInArrow(run, f"row long, id {kind}, digest binary, n long, fp long, keys array<long>").groupBy("digest")
    prints = prints.agg(F.min("row").alias("node"), F.min(F.struct("id", "row")).alias("best"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    prints = save(prints.drop("digest"), "prints")
    flat = save(prints.select("node", "n", F.explode("keys").alias("key")).unionAll(_fingerprint_bands(prints, radius)), "bands")
    shared = save(flat.groupBy("key").count().where("count > 1").select("key"), "shared-bands")
    bands = save(flat.join(shared.hint("merge"), "key", "left_semi"), "met-bands")
    wanted = save(bands.select(F.col("node").alias("__sh_row")).distinct(), "wanted")
    texts = rows.select("__sh_row", text_bytes(text_col).alias("text")).join(wanted.hint("merge"), "__sh_row")
    texts = save(texts.withColumnRenamed("__sh_row", "node"), "candidate-texts")
    labels = components(_similar(bands, texts, verify, similarity))
    first = prints.select("node", "best").join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("group")).agg(F.min("best").alias("best"))
    best = save(first.select(F.col("best.row").alias("__sh_row")), "best")
    return rows.join(best, "__sh_row", "left_semi").drop("__sh_row")
