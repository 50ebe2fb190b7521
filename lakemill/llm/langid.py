"""Language identification by averaged hashed subword embeddings (operator 2).

The lower-case text is cut at all ASCII characters that aren't letters.  Each
run of 2 to 5 UTF-8 bytes inside a word, its ends marked, is hashed into
``buckets`` rows of an embedding table.  A text is the mean of its subwords'
vectors; a linear softmax gives the languages.  Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``sample_rows`` rows of least hash, of very long texts an evenly
spread part).  Prediction always reads whole texts: as everything before the
softmax is linear, each subword has fixed logits, which are averaged.

Rejection: the temperature of the softmax and the least accepted probability
are set on rows of the sample that weren't trained on: the threshold is what
all but ``reject_share`` of them exceed, and never over ``max_threshold``, so
that clean texts stay.

Defined results: a null text, or one without a letter, is ``und``, scores 0 and
is rejected; without any labelled row every text is ``und``; ties go to the
first language in alphabetical order.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.workspace import least_hashes, small_batches

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
LONGEST = 5
#: Bytes of a text whose subwords are looked up at a time.
STRETCH = 1 << 20


@dataclass
class Settings:
    bits: int = 15
    dim: int = 16
    sample_rows: int = 3000
    epochs: int = 4
    rate: float = 0.6
    decay: float = 1e-5
    reject_share: float = 0.001
    max_threshold: float = 0.5
    seed: int = 7


def subwords(text: str, bits: int) -> Iterator[np.ndarray]:
    """Hashed subwords of a text, one array for each length and stretch."""
    line = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split()) + b" "
    for at in range(0, len(line), STRETCH):
        code = np.frombuffer(line, np.uint8, min(STRETCH + LONGEST, len(line) - at), at).astype(np.uint32)
        inside = code != 32
        h, whole = code[:-1] * np.uint32(0x01000193) + code[1:], None
        for n in range(2, min(LONGEST, len(code)) + 1):
            if n > 2:
                h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
                whole = inside[1:-1] if whole is None else whole[:-1] & inside[n - 2 : -1]
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
            yield mixed if whole is None else mixed[whole]


@dataclass
class Model:
    """Logits of each hashed subword, and what turns them into probabilities."""

    langs: list[str]
    bits: int
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, text: str) -> np.ndarray | None:
        """Uncalibrated logits of a text, or None without a letter."""
        if not self.langs or not _LETTER.search(text):
            return None
        total, n = np.zeros(len(self.langs)), 0
        for found in subwords(text, self.bits):
            total += self.logits.take(found, axis=0).sum(axis=0, dtype=np.float64)
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, probability, rejected)."""
        z = self.scores(text)
        if z is None:
            return UNKNOWN, 0.0, True
        p = softmax(z[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], s: Settings) -> Model:
    """Train on nine in ten rows, calibrate on the others."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], s.bits, np.zeros((1 << s.bits, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(s.seed)
    bags, y = [], []
    for text, label in zip(texts, labels):
        found = np.concatenate([*subwords(text, s.bits), np.zeros(0, np.uint32)])
        if len(found) and _LETTER.search(text):
            ids, n = np.unique(found, return_counts=True)
            bags.append((ids, (n / len(found)).astype(np.float32)))
            y.append(langs.index(label))
    held = np.arange(len(bags)) % 10 == 9
    emb = (rng.standard_normal((1 << s.bits, s.dim)) / s.dim).astype(np.float32)
    out = np.zeros((s.dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    train = np.flatnonzero(~held)
    steps, done = max(1, s.epochs * len(train)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(train):
            rate = s.rate * (1 - done / steps)
            done += 1
            ids, w = bags[k]
            hidden = w @ emb[ids]
            grad = softmax((hidden @ out + bias)[None])[0]
            grad[y[k]] -= 1
            back = out @ grad
            out -= rate * (np.outer(hidden, grad) + s.decay * out)
            bias -= rate * 0.1 * grad
            # Each subword has a small share of the mean, so its step is scaled up.
            emb[ids] -= (rate * 20) * w[:, None] * back
    model = Model(langs, s.bits, (emb @ out).astype(np.float32), bias.astype(float))
    check = [k for k in range(len(bags)) if held[k]]
    if len(check) >= 20:
        z = np.stack([bags[k][1] @ model.logits[bags[k][0]] + model.bias for k in check])
        truth = np.array([y[k] for k in check])
        loss = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 8, 26)}
        model.temperature = float(min(loss, key=loss.get))
        best = softmax(z / model.temperature).max(axis=1)
        model.threshold = float(min(s.max_threshold, np.quantile(best, s.reject_share)))
    return model


def train(docs: DataFrame, usable: Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most sample_rows of the rows where usable holds."""
    s = settings or Settings()
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.col(id_col).alias("i"))
    # Only an evenly spread part of a very long text is sent: at most 40 stretches.
    n = F.length("t")
    spread = F.when(n <= 20_000, F.col("t")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.substring("t", (k * n / 40).cast("int") + 1, F.lit(400))), " "))
    picked = least_hashes(rows.select(spread.alias("t"), "l", "i"), F.xxhash64("i"), s.sample_rows, rows.select("l").count())
    picked = picked.select("t", "l", F.xxhash64("i", "t").alias("h")).orderBy("h", "t", "l").collect()
    return fit([r.t for r in picked], [r.l for r in picked], s)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row, over whole texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(t.decode("utf-8", "replace")) if t else (UNKNOWN, 0.0, True) for t in batch.column(1).to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([bool(t) and not m.predict(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
