"""Benchmark decontamination by rare seeds and local alignment (operator 10).

Words are runs of letters and digits in lower case, so changed case, white
space and punctuation don't matter.  Every ``seed``-word n-gram of an item is a
seed, however many texts hold it: a copy may have been edited so that only
common n-grams are left whole.  Items shorter than a seed use their whole word
sequence.

One pass finds seeds in each whole text.  Where the seeds of an item are met,
the passage around them is aligned with the item, but only if it can count at
all: ``min_score`` needs that share of the item's words as matches, so a passage
that lacks more of them is passed over without any loss.  A Smith-Waterman
alignment (match +2, mismatch -1, gap -1) is scored as a share of the best
possible score; the passages are at most three item lengths long and overlapping
hits are joined, so a text of any length is covered in linear time.  A pair
counts from ``min_score``: all but about a fifth of the words in order, with
substitutions, insertions and deletions allowed.  A copy that keeps no ``seed``
words of the item in a row isn't met.

The items are sent to the executors only up to ``BLOCK_WORDS`` words; a larger
benchmark is gone through in blocks of that size, each against all texts.

Defined results: null and empty texts and items match nothing; equal items each
match; repeated rows each get their rows; an empty table gives no pairs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.workspace import save, small_batches, text_bytes

SEED = 4
MIN_SCORE = 0.6
#: Words of test items that are broadcast at a time (about 20 MB).
BLOCK_WORDS = 1_000_000
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], seed: int) -> list[tuple[str, ...]]:
    """The n-grams of a sequence; a shorter sequence is one gram."""
    if len(words) <= seed:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(seed))))


def hits(words: list[str], seeds: dict, lengths: list[int]) -> list[tuple[int, tuple]]:
    """(position, gram) of each gram of a text that is in seeds."""
    found = []
    for n in lengths:
        if n <= len(words):
            found += [(k, g) for k, g in enumerate(zip(*(words[j:] for j in range(n)))) if g in seeds]
    return found


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: (share of the best possible score, first, past the last) in passage.

    The rows go over the item, and a row is filled at once: the gaps along the
    passage are a running maximum, as each costs the same.
    """
    n = len(passage)
    row, start = np.zeros(n + 1, np.int32), np.arange(n + 1)
    best, span = 0, (0, 0)
    along = np.arange(n + 1, dtype=np.int32)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, 2, -1).astype(np.int32)
        up = row[1:] - 1
        value = np.zeros(n + 1, np.int32)
        origin = along.copy()
        value[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin[1:] = np.where(value[1:] == 0, along[1:], np.where(diagonal >= up, start[:-1], start[1:]))
        # A gap of any length from the best cell to the left.
        lifted = value + along
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, along, 0))
        better = reach - along > value
        value = np.where(better, reach - along, value)
        origin = np.where(better, origin[source], origin)
        row, start = value, origin
        at = int(row.argmax())
        if row[at] > best:
            best, span = int(row[at]), (int(start[at]), at)
    return best / (2 * max(1, len(item))), *span


def passages(positions: list[int], length: int, total: int) -> list[tuple[int, int]]:
    """Stretches around hits, joined where they overlap, cut to three lengths with an overlap of two."""
    joined: list[list[int]] = []
    for p in sorted(positions):
        a, b = max(0, p - length), min(total, p + 2 * length)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return [(a, min(a + 3 * length, end)) for begin, end in joined for a in range(begin, max(begin + 1, end - 2 * length), length)]


def matches_within(times: Counter, passage: list[str]) -> int:
    """How many words of an item, counted in times, an alignment with passage can match at most."""
    return sum(map(times.__getitem__, times.keys() & set(passage)))


def seeds_of(items: dict[int, list[str]], seed: int) -> dict[tuple, list[int]]:
    """The items of each seed."""
    out: dict[tuple, list[int]] = defaultdict(list)
    for item, found in items.items():
        for g in set(grams(found, seed)):
            out[g].append(item)
    return dict(out)


def _block(docs: DataFrame, block: list[tuple[object, str]], seed: int, min_score: float, id_col: str, text_col: str, item_type: str) -> DataFrame:
    items = {k: words_of(t) for k, (_, t) in enumerate(block)}
    seeds = seeds_of(items, seed)
    lengths = sorted({len(g) for g in seeds})
    sent = docs.sparkSession.sparkContext.broadcast((seeds, items, [i for i, _ in block], lengths))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, items, names, lengths = sent.value
        counts: dict[int, Counter] = {}
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(t.decode("utf-8", "replace"))
                by_item: dict[int, list[int]] = defaultdict(list)
                for at, g in hits(found, seeds, lengths):
                    for item in seeds[g]:
                        by_item[item].append(at)
                for item, at in by_item.items():
                    if item not in counts:
                        counts[item] = Counter(items[item])
                    times, n, best = counts[item], len(items[item]), (0.0, 0, 0)
                    likely = [(a, b) for a, b in passages(at, n, len(found)) if matches_within(times, found[a:b]) >= min_score * n]
                    if not likely:
                        continue
                    ids = {w: k for k, w in enumerate(times)}
                    own = np.array([ids[w] for w in items[item]])
                    for a, b in likely:
                        score, first, end = align(own, np.array([ids.get(w, -1) for w in found[a:b]]))
                        best = max(best, (score, a + first, a + end), key=lambda x: x[0])
                        if best[0] == 1:
                            break
                    if best[0] >= min_score:
                        for column, value in zip(rows, (key, names[item], *best)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], names=[f.name for f in schema])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wide = _parse_datatype_string(f"`{id_col}` {kind}, item_id {item_type}, score double, first_word int, end_word int")
    schema = list(to_arrow_schema(wide))
    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, wide)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, end_word) of each text that holds an item."""
    small_batches(docs.sparkSession)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    blocks, block, size = [], [], 0
    # The items come one partition at a time; a full block is worked off before the next is read.
    for r in benchmark.select(F.col(item_col), F.coalesce(F.col(item_text), F.lit("")).alias("t")).toLocalIterator():
        block.append((r[0], r[1]))
        size += r[1].count(" ") + 1
        if size >= BLOCK_WORDS:
            blocks.append(save(_block(docs, block, seed, min_score, id_col, text_col, item_type), "leaks"))
            block, size = [], 0
    if block or not blocks:
        blocks.append(_block(docs, block, seed, min_score, id_col, text_col, item_type))
    return reduce(DataFrame.union, blocks)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs whose text holds no test item.  Rows with equal ids are judged by their own texts."""
    keyed = docs.withColumn("__dc_hash", F.xxhash64(F.col(text_col)))
    texts = keyed.select(F.struct(F.col(id_col).alias("i"), F.col("__dc_hash").alias("h")).alias("__dc_key"), F.col(text_col).alias("text"))
    leaks = save(contaminated(texts, benchmark, id_col="__dc_key", text_col="text", **settings).select(F.col("__dc_key.i").alias("__dc_i"), F.col("__dc_key.h").alias("__dc_h")).distinct(), "leaked")
    same = keyed[id_col].eqNullSafe(leaks["__dc_i"]) & (keyed["__dc_hash"] == leaks["__dc_h"])
    return keyed.join(leaks, same, "left_anti").drop("__dc_hash")
