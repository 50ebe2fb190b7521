"""Token ids as binary blocks by a static range asymmetric numeral system (operator 6).

All ids share one frequency table, counted over the whole corpus and scaled to
2^20.  The ids of a run of whole documents, about ``BLOCK_IDS`` of them, are a
block.  Its ids are dealt to up to 1,024 interleaved lanes, each a 64-bit rANS
state that gives off 32-bit words; one numpy step codes an id of every lane.

The token file is a folder with ``blocks`` (Parquet rows, written by Spark's
commit protocol, so that a task that is run again leaves no half-written block;
files in the order of their names, and rows in the order in which they stand,
give the ids in ascending order of documents) and ``table`` (the frequencies).  A block is a binary record that can be
decoded with the table alone, in any order and place:

    magic 'RNB1', lanes, documents, ids, words      4 x u32 after the magic
    crc32 of the table, of the ids, of the payload  3 x u32
    payload: checkpoint of the global position u64, lane states u64 x lanes,
             documents (id i64, null u8, length u32), words u32 x words

The checkpoint says how many ids the corpus holds before the block.  Decoding
verifies all checksums and raises on any difference.

Defined results: a null or empty text is its end id alone; null ids sort first
and rows with equal ids by their texts' hash; an empty table gives a file
without blocks; a document is never cut, so one very long text is one large
block.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakemill.llm.runs import FIRST, SECOND, STRETCH, spans, stretches
from lakemill.llm.workspace import save, shared_dir, small_batches, text_bytes

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 18
MOST_LANES = 1024
#: Places for pieces that a worker remembers, half of which may be taken, and the bytes of the longest of them.
PLACE_BITS, SHORT, MARKS = 21, 64, 20_000
PLACES = 1 << PLACE_BITS
#: New words that are encoded as one text.
TOGETHER = 500
_MARKS = string.punctuation.encode()
_HEAD = struct.Struct("<4s7I")


class Table:
    """Frequencies scaled to 2^SCALE; every symbol that occurs keeps at least 1."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        ends = np.cumsum(freq)
        self.start = (ends - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^SCALE, with 1 at least for each count over 0."""
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size // 2:
        raise ValueError("too many symbols for the scale of the table")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
    over = int(freq.sum()) - size
    if over < 0:
        freq[freq.argmax()] -= over
    for k in np.argsort(-freq, kind="stable"):
        if over <= 0:
            break
        take = min(over, int(freq[k]) // 2)
        freq[k] -= take
        over -= take
    return freq


def encode_block(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(lane states, words) of a block of ids."""
    lanes = int(np.clip(len(ids) // 64, 1, MOST_LANES))
    steps = -(-len(ids) // lanes)
    padded = np.full(steps * lanes, ids[0], np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    room, half, mask = np.uint64(63 - SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
    for step in grid[::-1]:
        f = table.freq[step]
        full = x >= (f << room)
        words.append((x[full] & mask).astype(np.uint32))
        x = np.where(full, x >> half, x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + table.start[step]
    return x, np.concatenate(words[::-1])


def decode_block(states: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    x, lanes = states.astype(np.uint64), len(states)
    steps = -(-n // lanes)
    out = np.empty((steps, lanes), np.uint32)
    slot_mask, at = np.uint64((1 << SCALE) - 1), 0
    for k in range(steps):
        slot = x & slot_mask
        symbol = table.symbol[slot]
        out[k] = symbol
        x = table.freq[symbol] * (x >> np.uint64(SCALE)) + slot - table.start[symbol]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << np.uint64(32)) | words[at : at + len(empty)].astype(np.uint64)
            at += len(empty)
    return out.reshape(-1)[:n]


def pack_block(first: int, docs: list[tuple[int | None, np.ndarray]], table: Table) -> bytes:
    """A block record of whole documents; first: ids in the corpus before it."""
    ids = np.concatenate([d[1] for d in docs])
    states, words = encode_block(ids, table)
    index = b"".join(struct.pack("<qBI", 0 if i is None else i, i is None, len(x)) for i, x in docs)
    payload = struct.pack("<Q", first) + states.astype("<u8").tobytes() + index + words.astype("<u4").tobytes()
    return _HEAD.pack(b"RNB1", len(states), len(docs), len(ids), len(words), table.crc, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload)) + payload


def unpack_block(record: bytes, table: Table) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, ids before it in the corpus, ids) of each document of a block."""
    magic, lanes, docs, n, n_words, of_table, of_ids, of_payload = _HEAD.unpack_from(record)
    payload = memoryview(record)[_HEAD.size :]
    if magic != b"RNB1" or of_table != table.crc or zlib.crc32(payload) != of_payload:
        raise ValueError("damaged block, or another frequency table")
    at = 8 + 8 * lanes
    words_at = at + 13 * docs
    ids = decode_block(np.frombuffer(payload, "<u8", lanes, 8), np.frombuffer(payload, "<u4", n_words, words_at), n, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
        raise ValueError("a block's ids don't match their checksum")
    position = struct.unpack_from("<Q", payload)[0]
    begin = 0
    for k in range(docs):
        key, null, length = struct.unpack_from("<qBI", payload, at + 13 * k)
        yield None if null else key, position + begin, ids[begin : begin + length]
        begin += length


class PieceTable:
    """Ids of short pieces by 128 bits of hash, in arrays: open addressing over a power of two of places."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.place = np.full(PLACES, -1, np.int32)
        self.keys = np.zeros((2, PLACES // 2), np.uint64)
        self.start, self.size = np.zeros(PLACES // 2, np.int64), np.zeros(PLACES // 2, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key (two rows), or -1."""
        out, rest = np.full(keys.shape[1], -1, np.int64), np.arange(keys.shape[1])
        at = (keys[0] >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        while len(rest):
            found = self.place.take(at)
            same = (self.keys[0].take(found, mode="clip") == keys[0].take(rest)) & (self.keys[1].take(found, mode="clip") == keys[1].take(rest)) & (found >= 0)
            out[rest[same]] = found[same]
            more = np.flatnonzero((found >= 0) & ~same)
            rest, at = rest[more], (at[more] + 1) % PLACES
        return out

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
        """Take up new and different keys; their indices."""
        index = np.arange(self.n, self.n + len(ids))
        self.keys[:, index] = keys
        size = np.array([len(x) for x in ids], np.int64)
        self.size[index], self.start[index] = size, self.used + np.cumsum(size) - size
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(ids)
        at, rest = (keys[0] >> np.uint64(64 - PLACE_BITS)).astype(np.int64), index
        while len(rest):
            free = self.place.take(at) < 0
            self.place[at[free]] = rest[free]
            # Of those that met in one place the last has it.
            out = np.flatnonzero(self.place.take(at) != rest)
            rest, at = rest[out], (at[out] + 1) % PLACES
        return index

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces end to end, how many ids each has)."""
        size = self.size.take(index)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids.take(np.arange(total) + np.repeat(self.start.take(index) - ends + size, size)), size


class PieceEncoder:
    """The tokenizers library over the pieces between ASCII white space.

    This vocabulary's pre-tokenizer drops white space and never looks across
    it, so a text's ids are those of its pieces; each distinct piece of up to
    ``SHORT`` bytes is encoded once per worker and then found by its hash.  A
    word with marks before or behind it is three tokens of the pre-tokenizer:
    marks, word, marks.  New words are encoded many at a time, as one text, and
    told apart by the word-end mark of their last id.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.table = PieceTable()
        self.marks: dict[bytes, bytes] = {b"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _mark(self, run: bytes) -> bytes:
        if run not in self.marks:
            if len(self.marks) > MARKS:
                self.marks = {b"": b""}
            self.marks[run] = self._ids(run)
        return self.marks[run]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of new pieces."""
        memo: dict[bytes, bytes] = {}
        apart, single = [], []
        for p in new:
            word = p.strip(_MARKS)
            at = p.find(word)
            # A quote before letters may be a contraction, and <| a special token.
            if word and (word.isalpha() or _plain_word(word)) and b"<|" not in p and b"'" not in p[:at]:
                apart.append((p, at, word))
            else:
                single.append(p)
        words = list({w for _, _, w in apart})
        runs = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        found = self.tokenizer.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False)
        for run, e in zip(runs, found):
            ids = np.asarray(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(run):
                raw, begin = ids.tobytes(), 0
                for w, stop in zip(run, stops.tolist()):
                    memo[w] = raw[begin:stop]
                    begin = stop
            else:
                # Normalising has cut some word in two.
                for w in run:
                    memo[w] = self._ids(w)
        get, mark = self.marks.get, self._mark
        for p, at, word in apart:
            if len(p) > len(word):
                before, behind = p[:at], p[at + len(word) :]
                memo[p] = (get(before) or mark(before)) + memo[word] + (get(behind) or mark(behind))
        for p in single:
            memo[p] = self._ids(p)
        return [memo[p] for p in new]

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        blob = b"\n".join(texts)
        line = np.frombuffer(blob, np.uint8)
        start, end = spans(line)
        cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        keys = np.stack([FIRST.words(line, start, end), SECOND.words(line, start, end)])
        if self.table.n + len(start) > PLACES // 2:
            self.table.clear()
        index = self.table.find(keys)
        far = end - start > SHORT
        new = np.flatnonzero((index < 0) & ~far)
        if len(new):
            _, first, like = np.unique(keys[0, new] ^ (keys[1, new] * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
            at = new[first]
            pieces = [blob[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            index[new] = self.table.add(keys[:, at], [np.frombuffer(x, "<u4") for x in self._learn(pieces)])[like]
        index[far] = 0
        flat, size = self.table.gather(index)
        stops = np.cumsum(size)
        if far.any():
            # Long pieces aren't remembered; each is encoded where it stands.
            out, done = [], 0
            for k in np.flatnonzero(far).tolist():
                out += [flat[done : stops[k] - size[k]], np.frombuffer(self._ids(blob[start[k] : end[k]]), "<u4")]
                done = stops[k]
                size[k] = len(out[-1])
            flat, stops = np.concatenate([*out, flat[done:]]), np.cumsum(size)
        return np.split(flat, np.append(0, stops)[cuts[:-1]])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        # The vocabulary has lower case only; for ASCII letters that is done here,
        # unless that could make a special token of ordinary text.
        texts = [t if b"<|" in t else t.lower() for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for which, parts in stretches(texts):
            if len(parts[0]) > STRETCH:
                out[which[0]].append(np.frombuffer(self._ids(parts[0]), "<u4"))
                continue
            for k, found in zip(which, self._group(parts)):
                out[k].append(found)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


def _plain_word(word: bytes) -> bool:
    """Letters, in lower case too, of the scripts up to Cyrillic: letters by any version of Unicode."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0530" and text.lower().isalpha()


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_rows(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, at, id, ids): documents in ascending order; at: ids before it in its part."""
    small_batches(docs.sparkSession)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.select(id_col).rdd.getNumPartitions())
    end = np.asarray([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = piece_encoder(path), 0
        for batch in batches:
            ids = encoder.encode(batch.column(2).to_pylist())
            starts = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in ids])]).astype(np.int64)
            at = int(starts[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts[:-1], pa.int64()), batch.column(1), pa.array([np.append(x, end).astype("<u4").tobytes() for x in ids], pa.binary())], names=["part", "at", "id", "ids"])

    text = text_bytes(text_col).alias("text")
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), text).repartitionByRange(parts, "id").sortWithinPartitions("id", F.crc32("text"))
    return ordered.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, "part int, at long, id long, ids binary")


def _part_sums(rows: DataFrame, vocabulary: int) -> tuple[np.ndarray, dict[int, int]]:
    """Counts of each id, and the ids of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = np.zeros(vocabulary, np.int64), {}
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            counts += np.bincount(np.frombuffer(b"".join(blobs), "<u4"), minlength=vocabulary)
            for part, ids in zip(batch.column(0).to_pylist(), blobs):
                parts[part] = parts.get(part, 0) + len(ids) // 4
        some = np.flatnonzero(counts)
        keys = [*some.tolist(), *(-1 - p for p in parts)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*counts[some].tolist(), *parts.values()], pa.int64())], names=["key", "n"])

    counts, parts = np.zeros(vocabulary, np.int64), {}
    for r in rows.select("part", "ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        if r.key < 0:
            parts[-1 - r.key] = r.n
        else:
            counts[r.key] = r.n
    return counts, parts


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the token file into folder."""
    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    rows = save(token_rows(docs, path, end_id, id_col, text_col), "tokens")
    counts, parts = _part_sums(rows, vocabulary)
    freq, before, total = scaled(counts), {}, 0
    for part in sorted(parts):
        before[part] = total
        total += parts[part]
    sent = spark.sparkContext.broadcast((freq, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, before = sent.value
        table = Table(freq)
        first, run_end, held, n = 0, None, [], 0

        def flush() -> pa.RecordBatch:
            record = pack_block(first, held, table)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([record], pa.binary())], names=["first", "record"])

        for batch in batches:
            for part, at, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                start, found = before[part] + at, np.frombuffer(ids, "<u4")
                if held and (start != run_end or n >= BLOCK_IDS):
                    yield flush()
                    held, n = [], 0
                if not held:
                    first = start
                held.append((key, found))
                n += len(found)
                run_end = start + len(found)
        if held:
            yield flush()

    # Each file holds a range of the corpus, the first file the first, and its blocks in order.
    files = max(1, len(parts))
    packed = rows.mapInArrow(run, "first long, record binary").repartitionById(files, F.least(F.floor(F.col("first") * files / max(1, total)), F.lit(files - 1)).cast("int")).sortWithinPartitions("first")
    packed.write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(vocabulary, end_id, freq.astype("<u4").tobytes())], "vocabulary int, end_id int, freq binary").coalesce(1).write.parquet(f"{folder}/table")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document of a token file, decoded in parallel."""
    freq = np.frombuffer(spark.read.parquet(f"{folder}/table").first()["freq"], "<u4").astype(np.int64)
    sent = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        for batch in batches:
            for record in batch.column(0):
                found = list(unpack_block(record.as_py(), table))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].astype("<u4").tobytes() for x in found], pa.binary())], names=["doc_id", "start", "ids"])

    return spark.read.schema("first long, record binary").parquet(f"{folder}/blocks").select("record").mapInArrow(run, "doc_id long, start long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lakemill/token-file-{uuid.uuid4().hex}"
