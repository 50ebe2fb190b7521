"""Byte-level BPE encoding and decoding (operator 9).

Each piece of text is encoded by a contiguous rank array: one list holds the
ids of the parts, a second the rank of each adjacent pair; the least rank is
found by scanning, its boundary is deleted and the two ranks beside it are
looked up again.  Words are short, so a scan beats a heap; pieces over
``SCAN_LIMIT`` bytes (a megabyte of letters without a space, say) use a heap
over a linked list, so time stays near-linear.

A text is first cut where a space is followed by a character that isn't white
space.  The pre-tokenizer always starts a new token there, so the cut pieces
can be encoded independently, and each distinct piece is encoded once per
worker.

Defined results: a null or empty text has no ids and decodes to ''; repeated
rows give repeated results; an empty table gives an empty table; bytes that
aren't UTF-8 are read as U+FFFD.  Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.workspace import small_batches, text_bytes

SCAN_LIMIT = 256
#: Distinct pieces that a worker remembers before it starts afresh.
REMEMBERED = 800_000

_NONE = 1 << 30
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_UNSAFE = re.compile(r" (?:\s|\Z)|\A\s")
_CUT = re.compile(r" (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


class RankTable:
    """A vocabulary of byte-level BPE with its merges, ready to encode and decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.token_bytes.update({i: t.encode() for t, i in self.special.items()})
        self.byte_id = [0] * 256
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        self.pair_rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair_rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._first: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > SCAN_LIMIT:
            return self._merge_long(ids)
        look, made = self.pair_rank.get, self.made
        ranks = [look(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            ids[at] = made[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = look(ids[at] << 20 | ids[at + 1], _NONE)
            if at:
                ranks[at - 1] = look(ids[at - 1] << 20 | ids[at], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        look, n = self.pair_rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := look(ids[k] << 20 | ids[k + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt >= n or look(ids[k] << 20 | ids[nxt], _NONE) != rank:
                continue
            ids[k], ids[nxt] = self.made[rank], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (r := look(ids[k] << 20 | ids[after[k]], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := look(ids[before[k]] << 20 | ids[k], _NONE)) != _NONE:
                heapq.heappush(heap, (r, before[k]))
        return [i for i in ids if i >= 0]

    def piece(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a stretch of text without special tokens."""
        ids: list[int] = []
        for token in _PIECES.findall(text):
            ids += self.merge(token.encode("utf-8"))
        return np.asarray(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        cut = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        if len(self._spaced) > REMEMBERED:
            self._spaced.clear()
        return self.piece(cut[0]) + b"".join(map(self._spaced.__getitem__, cut[1:]))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self._special.finditer(text):
            if found.start() > at:
                out.append(self._plain(text[at : found.start()]))
            out.append(np.asarray([self.special[found[0]]], "<u4").tobytes())
            at = found.end()
        if at < len(text):
            out.append(self._plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; special tokens are kept."""
        look = self.token_bytes.__getitem__
        return b"".join(map(look, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Memo(dict):
    """Ids of each piece that follows a space."""

    def __init__(self, table: RankTable) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, text: str) -> bytes:
        word = text[:-1]
        if text[-1:] in (",", ".") and word.isascii() and word.isalpha():
            # Letters with one mark behind them are two tokens: the word and the mark.
            out = self[text] = self[word] + self.table.piece(text[-1])
        else:
            out = self[text] = self.table.piece(" " + text)
        return out


_TABLES: dict[str, RankTable] = {}


def rank_table(path: str) -> RankTable:
    """One table per worker and path."""
    if path not in _TABLES:
        _TABLES[path] = RankTable(path)
    return _TABLES[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, ids (binary, little-endian 32-bit), decoded text."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank_table(path)
        for batch in batches:
            ids = [table.encode(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            back = [table.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=[id_col, "ids", "decoded"])

    slim = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, ids binary, decoded string")


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of the ids and of the decoded texts."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_vocabulary(spark: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
