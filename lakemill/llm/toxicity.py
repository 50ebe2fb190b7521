"""Toxicity by a linear classifier over n-grams scaled by log-count ratios (operator 5).

The text, A-Z and other cased letters in lower case, is a sequence of UTF-8
bytes in which each run of white space or ASCII punctuation is one space.  Runs
of ``shortest`` to ``longest`` bytes are hashed into 2^bits features; a feature
is present in a text or not.  Each feature is scaled by its naive Bayes
log-count ratio r = log((a + p) / |a + p|) - log((a + q) / |a + q|), where p and
q count toxic and other texts with the feature.  The ``kept`` features of
greatest |r| weighted by the root of their count enter a logistic regression
with an L2 penalty, fitted by Adam in numpy.

The fit uses at most ``sample_rows`` labelled rows of least hash, and of those
only texts up to ``train_chars`` characters (a bound on the driver's memory).
Prediction reads whole texts of any length.

Defined results: null and empty texts have no features and score by the bias
alone; without labelled rows of both kinds every score is the smoothed share of
label 1; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.workspace import least_hashes, save, small_batches

_SPACES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
STRETCH = 1 << 20


@dataclass
class Settings:
    bits: int = 18
    shortest: int = 3
    longest: int = 7
    sample_rows: int = 6000
    train_chars: int = 20_000
    kept: int = 6000
    smooth: float = 1.0
    penalty: float = 3e-4
    rounds: int = 250
    rate: float = 0.05


def ngrams(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, one array for each length and stretch."""
    line = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split()) + b" "
    for at in range(0, len(line), STRETCH):
        code = np.frombuffer(line, np.uint8, min(STRETCH + s.longest, len(line) - at), at).astype(np.uint32)
        h = code
        for n in range(2, min(s.longest, len(code)) + 1):
            h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
            if n >= s.shortest:
                yield (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - s.bits)


@dataclass
class Model:
    settings: Settings
    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """The probability of label 1."""
        found = [np.zeros(0, np.int32)]
        for h in ngrams(text, self.settings):
            slots = self.slot.take(h)
            found.append(slots[slots >= 0])
        z = self.bias + float(self.weight[np.unique(np.concatenate(found))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[str], labels: list[int], s: Settings) -> Model:
    y = np.array(labels, float)
    size, none = 1 << s.bits, np.full(1 << s.bits, -1, np.int32)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(s, none, np.zeros(0), float(np.log(share / (1 - share))))
    seen = np.zeros(size, bool)
    bags = []
    counts = np.zeros((2, size), np.float64)
    for text, label in zip(texts, labels):
        seen[:] = False
        for h in ngrams(text, s):
            seen[h] = True
        bags.append(np.flatnonzero(seen).astype(np.int32))
        counts[int(label)][bags[-1]] += 1
    q, p = counts + s.smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    value = np.abs(ratio) * np.sqrt(counts.sum(axis=0))
    value[counts.sum(axis=0) < 3] = 0
    kept = np.flatnonzero(value > 0)
    kept = np.sort(kept[np.argsort(-value[kept], kind="stable")[: s.kept]])
    slot = none.copy()
    slot[kept] = np.arange(len(kept))
    rows = [x[x >= 0] for x in (slot[b] for b in bags)]
    cols = np.concatenate([*rows, np.zeros(0, np.int32)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    r = ratio[kept]
    # An offset takes up the share of the features that any text has.
    w, bias = np.zeros(len(kept)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, s.rounds + 1):
        z = np.bincount(of, (w * r)[cols], len(rows)) + bias
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(cols, err[of], len(kept)) * r / len(y) + s.penalty * w, err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return Model(s, slot, (w * r).astype(np.float64), bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most sample_rows of the labelled rows where usable holds."""
    s = settings or Settings()
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    rows = docs.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") <= s.train_chars)
    # The sample is chosen by ids alone, so that few texts are moved.
    held = save(marked.join(rows.select("id"), "id", "left_semi"), "labelled")
    chosen = least_hashes(held, F.xxhash64("id"), s.sample_rows, held.count())
    picked = rows.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "y", "t").limit(s.sample_rows).collect()
    return fit([r.t for r in picked], [int(r.y) for r in picked], s)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, over whole texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            score = [m.score((t or b"").decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, score double")
