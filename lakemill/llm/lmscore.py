"""Language-model scores by online logistic context mixing (operator 1).

A text is its tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and
one end.  Each token is coded as binary decisions, and the model's probability
of the text is the product of the probabilities of these bits:

* A word of the coding vocabulary (the ``HEAD`` most frequent training tokens
  that occur ``CODED_COUNT`` times) or the end follows its path in a Huffman
  tree.  Each bit is predicted from three contexts: the tree node; a hash of
  node and previous word (a rare one by its last bytes); a hash of node and the
  last word that is among the ``COMMON_WORDS`` most frequent.  The path ends at
  nodes of under ``NODE_SHARE`` of all tokens, below which exact counts decide.
* Any other word follows the path of an escape.  If training has it, its exact
  count says its share of all such words; a new word's bytes and a final space
  are spelt, each by its path in a Huffman tree of bytes, predicted from hashes
  of the node with one, three and five bytes before.
* A text is cut into chunks of about ``CHUNK_WORDS`` tokens where a hash of two
  words says so.  How often the four words before a chunk were followed by the
  same chunk in other texts is counted exactly; these counts with an absolute
  discount are mixed with the product of the chunk's bits.

Training: executors count zeros and ones in every context slot over all training
texts; the counts are summed part by part in two levels (salted, then whole).
These tables grow with the tokens up to ``MOST_SLOTS``, a bound on what a worker
holds; the counts of words and of chunks grow with the corpus without a bound,
stay distributed and are joined.  A slot's logit is log((n1 + 0.4) / (n0 + 0.4)),
and none for slots never seen.  The logits are combined by weights that a gate
chooses, namely how often the longer contexts have been seen.  Weights and a
final adaptive probability map (per gate, over the mixed logit) start from fixed
values and learn while a text is scored: after each ``BLOCK`` tokens the bits just
coded update both.  Spelt bits learn likewise.  Each text starts afresh, so a
score depends on the model and the text alone and texts can be scored anywhere,
in any order; no sample is taken.

A training text's own chunks are taken off the chunk counts before it is scored,
so that a copied text is told from one that only training has.  Bits per byte are
-score / log10(2) / bytes.  The base score is a unigram model with c, N and V of
all training tokens, exact for every token.

Defined results: a null text is empty and has its end alone; without training
texts all counts are 0; rows that repeat an id each get a row, and equal texts
equal scores if both or neither are training texts.  A very long text is read in
stretches of 4 MB, cut at white space.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.runs import FIRST, STRETCH, spans, spread, stretches
from lakemill.llm.workspace import save, small_batches, text_bytes

END_TOKEN = b"\n"
HEAD = 1 << 18
CODED_COUNT = 3
#: A longer token isn't kept in the broadcast head, which bounds its bytes.
HEAD_BYTES = 64
BLOCK = 64
#: Words that are spelt before their bits are learned from.
SPELT_BLOCK = 16
#: log2 of the most slots of a word context's table, and of the slots of the three byte contexts.
MOST_SLOTS, BYTE_SLOTS = (22, 19), (16, 18, 20)
#: The most frequent words are contexts of their own; others are so by a hash of their last three bytes.
CONTEXT_WORDS, CONTEXT_ENDS, COMMON_WORDS = 1 << 12, 12, 64
#: The least share of all tokens of a tree node whose decision is mixed; rarer ones follow the exact counts.
NODE_SHARE = 2.0**-10
PART = 1 << 14
LANE_TOKENS = 60_000
FLUSH = 400_000
SALTS = 16
CHUNK_WORDS = 24
DISCOUNT = 0.5
#: Learning rates of the weights (words, bytes) and of the probability map.
RATES, MAP_RATE = (0.002, 0.004), 0.015

#: Bytes that a spelt byte is predicted from, in each of the three contexts.
ORDERS = (1, 3, 5)
_BEFORE = bytes(ORDERS[-1])
_MULT = np.uint32(0x9E3779B1)
_BINS = 24
#: How far a cell of the probability map moves after so many bits; a step has far fewer bits for one cell.
_LEARNT = 1 - (1 - MAP_RATE) ** np.arange(1 << 14)
_END_HASH = np.uint64(0x5851F42D4C957F2D)


def _hash(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    h = (a * np.uint32(0x85EBCA6B)) ^ (b * _MULT)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    return h


def huffman(counts: np.ndarray, share: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length) of each symbol's path, nodes and bits of all paths, and the log2 probability of what the path leaves open.

    A path ends above the first node that holds less than share of all counts;
    the heavier nodes are numbered from 0.
    """
    n = len(counts)
    heap = [(int(c) or 1, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, weight = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8), np.ones(2 * n - 1)
    weight[:n] = np.maximum(counts, 1)
    made = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j], weight[made] = made, made, 1, a + b
        heapq.heappush(heap, (a + b, made))
        made += 1
    heavy = weight >= share * weight[-1]
    number = np.cumsum(heavy[n:]) - 1
    # All symbols climb at once, one node a step.
    at, cut, levels = np.arange(n), np.arange(n), []
    while True:
        up = at != made - 1
        if not up.any():
            break
        above = np.where(up, parent[at], at)
        kept = up & heavy[above]
        cut = np.where(up & ~heavy[above], above, cut)
        levels.append((kept, np.where(kept, number[above - n], 0), side[at]))
        at = above
    length = sum((kept.astype(np.int64) for kept, _, _ in levels), np.zeros(n, np.int64))
    start = np.cumsum(length) - length
    nodes, bits, done = np.zeros(int(length.sum()), np.uint32), np.zeros(int(length.sum()), np.uint8), np.zeros(n, np.int64)
    for kept, node, bit in levels:
        done += kept
        where = (start + length - done)[kept]
        nodes[where], bits[where] = node[kept], bit[kept]
    return start, length, nodes, bits, np.log2(weight[:n] / weight[cut]).astype(np.float32)


@dataclass
class Tokens:
    """A text's places in the head (-1: not there), its tokens' hashes, what they are as contexts, and the tokens that aren't in the head."""

    place: np.ndarray
    hashed: np.ndarray
    context: np.ndarray
    tail: list[bytes]


def _joined(parts: list[Tokens]) -> Tokens:
    place, hashed, context = (np.concatenate([getattr(p, c) for p in parts]) if parts else np.zeros(0, kind) for c, kind in (("place", np.int32), ("hashed", np.uint64), ("context", np.uint32)))
    return Tokens(place, hashed, context, [t for p in parts for t in p.tail])


class Coder:
    """Texts to symbols, and symbols to bits with their context slots."""

    def __init__(self, head: list[bytes], counts: np.ndarray, total: int, ends: int) -> None:
        self.counts = counts.astype(np.float64)
        self.coded = len(head)
        self.escape, self.end = self.coded, self.coded + 1
        self.in_tail = max(0, total - ends - int(counts.sum()))
        self.start, self.length, self.node, self.bit, self.rest = huffman(np.concatenate([counts, [max(1, self.in_tail), max(1, ends)]]), NODE_SHARE)
        # Slots for the tokens: 2 to the power of bits.
        bits = int(np.clip(np.ceil(np.log2(max(2, total))), 14, MOST_SLOTS[0]))
        self.slots = (max(1, int(np.ceil(np.log2(len(self.node) and int(self.node.max()) + 1 or 1)))), bits, min(bits, MOST_SLOTS[1]))
        self.starts = np.cumsum([0, *(1 << s for s in self.slots)])
        # The head's hashes in order, and where each value of their top 20 bits begins.
        line = np.frombuffer(b"".join(head), np.uint8)
        stops = np.cumsum([len(t) for t in head], dtype=np.int64)
        keys = FIRST.words(line, stops - np.array([len(t) for t in head], np.int64), stops)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], np.uint64((1 << 64) - 1)), np.append(order, -1).astype(np.int32)
        self.first = np.searchsorted(keys[order], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(h), -1, np.int32), np.arange(len(h))
        at = self.first.take((h >> np.uint64(44)).astype(np.int64))
        while len(rest):
            key = self.keys.take(at)
            hit = key == h
            out[rest[hit]] = self.rank.take(at[hit])
            more = np.flatnonzero(key < h)
            rest, at, h = rest[more], at[more] + 1, h[more]
        return out

    def read(self, texts: list[bytes]) -> list[Tokens]:
        """The tokens of each text; many short texts are read at once."""
        out: list[list[Tokens]] = [[] for _ in texts]
        for which, parts in stretches(texts):
            for k, found in zip(which, self._long_word(parts[0]) if len(parts[0]) > STRETCH else self._group(parts)):
                out[k].append(found)
        return [found[0] if len(found) == 1 else _joined(found) for found in out]

    def _group(self, texts: list[bytes]) -> list[Tokens]:
        blob = b"\n".join(texts).lower()
        line = np.frombuffer(blob, np.uint8)
        start, end = spans(line)
        h = FIRST.words(line, start, end)
        place = self.places(h)
        place[end - start > HEAD_BYTES] = -1
        context = _endings(line, start, end)
        often = (place >= 0) & (place < CONTEXT_WORDS)
        context[often] = place[often]
        cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()
        far = np.flatnonzero(place < 0)
        tail = [blob[a:b] for a, b in zip(start[far].tolist(), end[far].tolist())]
        stops = np.searchsorted(far, cuts).tolist()
        return [Tokens(place[a:b], h[a:b], context[a:b], tail[i:j]) for a, b, i, j in zip([0, *cuts], cuts, [0, *stops], stops)]

    def _long_word(self, word: bytes) -> list[Tokens]:
        word, end = word.lower(), np.array([len(word)])
        return [Tokens(np.full(1, -1, np.int32), np.array([xxhash.xxh64_intdigest(word)], np.uint64), _endings(np.frombuffer(word, np.uint8), end - end, end), [word])]

    def symbols(self, place: np.ndarray) -> np.ndarray:
        return np.append(np.where(place < 0, self.escape, place), self.end)

    def bits(self, symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(token, bit, slots in the tables, which lie end to end) of each bit of a run of symbols."""
        length = self.length.take(symbol)
        token = np.repeat(np.arange(len(symbol)), length)
        flat = np.arange(len(token)) + np.repeat(self.start.take(symbol) - np.cumsum(length) + length, length)
        node = self.node.take(flat)
        slots = [node.astype(np.int64)]
        for k, context in ((1, one), (2, two)):
            slots.append(_hash(context.take(token), node, self.slots[k]).astype(np.int64))
            slots[k] += self.starts[k]
        return token, self.bit.take(flat), slots


class Speller:
    """Words to bits of their bytes with their context slots."""

    def __init__(self, byte_counts: np.ndarray) -> None:
        self.start, self.length, self.node, self.bit, _ = huffman(byte_counts * 4 + 1)
        self.slots = BYTE_SLOTS
        self.starts = np.cumsum([0, *(1 << s for s in self.slots)])

    def bits(self, tail: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(word, bit, slots) of each bit of some spelt words."""
        line = np.frombuffer(b"".join([_BEFORE + t + b" " for t in tail]), np.uint8)
        size = np.array([len(t) + len(_BEFORE) + 1 for t in tail])
        begin = np.cumsum(size) - size
        at = np.arange(len(line))
        word = np.repeat(np.arange(len(tail)), size)
        inside = at - begin[word] >= len(_BEFORE)
        at, word = at[inside], word[inside]
        byte = line[at]
        length = self.length[byte]
        each = np.repeat(np.arange(len(byte)), length)
        flat = np.arange(len(each)) - np.repeat(np.cumsum(length) - length - self.start[byte], length)
        node, slots = self.node[flat], []
        # A word's bytes so far, the latest first; zeros stand before it.
        before, done = np.zeros(len(byte), np.uint32), 0
        for order, size in zip(ORDERS, self.slots):
            for k in range(done + 1, order + 1):
                before = before * np.uint32(0x01000193) + line[at - k] + np.uint32(1)
            done = order
            slots.append(_hash(before[each], node, size))
        return word[each], self.bit[flat], [s.astype(np.int64) + a for s, a in zip(slots, self.starts)]


def _endings(line: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A context for each token from its last three bytes."""
    last, h = line.astype(np.uint32), np.zeros(len(start), np.uint32)
    for k in (1, 2, 3):
        h = h << np.uint32(8) | np.where(end - k >= start, last.take(np.maximum(end - k, 0)), 0).astype(np.uint32)
    return np.uint32(CONTEXT_WORDS) + _hash(h, h, CONTEXT_ENDS)


#: What stands before a text.
_START = np.uint32(CONTEXT_WORDS + (1 << CONTEXT_ENDS))


def _run_of(texts: list[Tokens], coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, previous context, last common word, size of each text) of the texts' symbols end to end."""
    size = np.array([len(t.place) + 1 for t in texts])
    begin = np.cumsum(size) - size
    symbol = np.concatenate([coder.symbols(t.place) for t in texts])
    one = np.concatenate([np.append(_START, t.context) for t in texts])
    # The last of the most frequent words, which says much of a text's language.
    few = (one < COMMON_WORDS) | (one == _START)
    two = one[few][np.cumsum(few) - 1]
    return symbol, one, two, size


class Tables:
    """Of every slot the logit and the confidence: steps of 1/256 from -32 above two low bits for the confidence (0 to 3)."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray) -> None:
        logit = np.log((ones + 0.4) / (zeros + 0.4))
        seen = np.digitize(zeros + ones, [1, 3, 12]).astype(np.uint16)
        self.packed = (np.rint(logit * 256) + 8192).astype(np.uint16) << np.uint16(2) | seen

    def inputs(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, gate) of each bit."""
        x = np.empty((3, len(slots[0])), np.float32)
        gate = np.zeros(len(slots[0]), np.int64)
        for k, s in enumerate(slots):
            found = self.packed.take(s)
            np.multiply(found >> np.uint16(2), np.float32(1 / 256), out=x[k])
            if k:
                gate = gate * 4 + (found & np.uint16(3))
        x -= np.float32(32)
        return x, gate


class SlotCounts:
    """Zeros and ones of the slots, counted in place."""

    def __init__(self, slots: int) -> None:
        self.sums = np.zeros(2 * slots, np.uint32)

    def add(self, bit: np.ndarray, slots: list[np.ndarray]) -> None:
        for s in slots:
            np.add.at(self.sums, s * 2 + bit, np.uint32(1))


def starting_weights(spelling: bool) -> np.ndarray:
    """Weights of the three contexts in each of the 16 gates, gate = 4 x confidence of the second + that of the third.

    Fixed values: the shares of the second and third context by their confidence.
    """
    one, two = np.meshgrid(np.arange(4), np.arange(4), indexing="ij")
    share = np.array([[0, 0.3, 0.5, 0.6], [0, 0.2, 0.4, 0.6]] if spelling else [[0, 0.15, 0.3, 0.5], [0, 0.15, 0.3, 0.5]])
    b, c = share[0][one], share[1][two]
    a = np.maximum(0, 1 - b - c)
    return np.stack([a.ravel(), b.ravel(), c.ravel()]).astype(np.float32)


class Lanes:
    """Weights and adaptive probability maps of some texts that are scored side by side."""

    def __init__(self, start: np.ndarray, lanes: int, rate: float) -> None:
        self.weight, self.rate = np.tile(start, (1, lanes)), rate
        self.refine = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, _BINS + 1)))).astype(np.float32), (lanes * 16, 1))

    def step(self, lane: np.ndarray, gate: np.ndarray, x: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log2 probability of each bit; then learn from them."""
        at = lane * 16 + gate
        z = self.weight[0].take(at)
        z *= x[0]
        for k in (1, 2):
            z += self.weight[k].take(at) * x[k]
        np.clip(z, -7.99, 7.99, out=z)
        p = np.exp(-z)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        z += np.float32(8)
        z *= np.float32(_BINS / 16)
        low = z.astype(np.int64)
        z -= low
        cell = at * (_BINS + 1)
        cell += low
        flat, real = self.refine.reshape(-1), bit.astype(np.float32)
        q = flat.take(cell)
        q += (flat.take(cell + 1) - q) * z
        # The mean of both, as the probability of the bit that came.
        q += p
        q *= np.float32(-0.5)
        q += real
        np.abs(q, out=q)
        np.subtract(np.float32(1), q, out=q)
        np.clip(q, 1e-5, 1 - 1e-5, out=q)
        out = np.log(q)
        out *= np.float32(1.4426950408889634)
        np.subtract(real, p, out=p)
        p *= np.float32(self.rate)
        for k in range(3):
            self.weight[k] += np.bincount(at, p * x[k], self.weight.shape[1])
        near = cell + (z > 0.5)
        n = np.bincount(near, minlength=flat.size)
        some = np.flatnonzero(n)
        count = n.take(some)
        mean = np.bincount(near, real, flat.size).take(some) / count
        old = flat.take(some)
        flat[some] = old + _LEARNT.take(count, mode="clip") * (mean - old)
        return out


@dataclass
class Model:
    coder: Coder
    tables: Tables
    speller: Speller
    letters: Tables
    new: float = 0.5
    _weights: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (starting_weights(False), starting_weights(True)))

    def score(self, texts: list[Tokens], known: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """log2 probability of each token of each text (an escape without its word), and of each of its spelt words.

        known: the texts of which training has all words, so that none is spelt.
        """
        bits: list[np.ndarray] = [np.zeros(0, np.float32)] * len(texts)
        for part in _groups([len(t.place) for t in texts], LANE_TOKENS):
            for k, found in zip(part, self._words([texts[k] for k in part])):
                bits[k] = found
        spelt = [np.zeros(len(t.tail), np.float32) for t in texts]
        some = [k for k, t in enumerate(texts) if t.tail and not known[k]]
        for part in _groups([sum(map(len, texts[k].tail)) for k in some], LANE_TOKENS):
            part = [some[k] for k in part]
            for k, found in zip(part, self._spelt([texts[k].tail for k in part])):
                spelt[k] = found
        return bits, spelt

    def _words(self, texts: list[Tokens]) -> list[np.ndarray]:
        symbol, one, two, size = _run_of(texts, self.coder)
        begin = np.cumsum(size) - size
        lane = np.repeat(np.arange(len(texts)), size)
        block = (np.arange(len(symbol)) - np.repeat(begin, size)) // BLOCK
        # Blocks of all lanes in turn, so that each step is a slice.
        turn = np.argsort(block, kind="stable")
        symbol, one, two, lane, block = symbol[turn], one[turn], two[turn], lane[turn], block[turn]
        lanes, cost = Lanes(self._weights[0], len(texts), RATES[0]), np.empty(len(symbol), np.float32)
        ends = np.searchsorted(block, np.arange(block[-1] + 2))
        for a, b in zip(ends, ends[1:]):
            token, bit, slots = self.coder.bits(symbol[a:b], one[a:b], two[a:b])
            x, gate = self.tables.inputs(slots)
            cost[a:b] = np.bincount(token, lanes.step(lane[a:b].take(token), gate, x, bit), b - a)
        cost += self.coder.rest.take(symbol)
        out = np.empty(len(symbol), np.float32)
        out[turn] = cost
        return np.split(out, begin[1:])

    def _spelt(self, tails: list[list[bytes]]) -> list[np.ndarray]:
        lanes, out = Lanes(self._weights[1], len(tails), RATES[1]), [np.empty(len(t), np.float32) for t in tails]
        most = max(map(len, tails))
        for at in range(0, most, SPELT_BLOCK):
            here = [(k, t[at : at + SPELT_BLOCK]) for k, t in enumerate(tails) if len(t) > at]
            lane = np.repeat([k for k, _ in here], [len(t) for _, t in here])
            word, bit, slots = self.speller.bits([w for _, t in here for w in t])
            x, gate = self.letters.inputs(slots)
            cost = np.bincount(word, lanes.step(lane[word], gate, x, bit), len(lane)).astype(np.float32)
            begin = 0
            for k, t in here:
                out[k][at : at + len(t)] = cost[begin : begin + len(t)]
                begin += len(t)
        return out


def _groups(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Indices in order of size, in groups of most in all or one each."""
    part, n = [], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and n + sizes[k] > most:
            yield part
            part, n = [], 0
        part.append(k)
        n += sizes[k]
    if part:
        yield part


def chunks(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, context, hash) of each chunk of a text's tokens and end, from the second; the first has no context."""
    h = np.append(hashed, _END_HASH)
    start = np.zeros(0, np.int64)
    if len(h) > 4:
        mixed = spread(h[3:-1] * np.uint64(0xA24BAED4963EE407) + h[2:-2])
        start = np.flatnonzero(mixed < np.uint64((1 << 64) // CHUNK_WORDS)) + 4
    if not len(start):
        return start, start.astype(np.uint64), start.astype(np.uint64)
    runs = FIRST.runs(h, np.concatenate([start - 4, start]), np.concatenate([start, start[1:], [len(h)]]))
    return start, runs[: len(start)], runs[len(start) :]


def _count_words(counts: Counter, blob: bytes) -> None:
    """Add the words of a line; equal hashes are counted first, each word is cut out once."""
    line = np.frombuffer(blob, np.uint8)
    start, end = spans(line)
    # Bytes tell long words apart.
    long = end - start > HEAD_BYTES
    counts.update([blob[a:b] for a, b in zip(start[long].tolist(), end[long].tolist())])
    start, end = start[~long], end[~long]
    _, first, n = np.unique(FIRST.words(line, start, end), return_index=True, return_counts=True)
    before = counts.get
    for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
        word = blob[a:b]
        counts[word] = before(word, 0) + k


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) of all training tokens, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

        size = 0
        for batch in batches:
            for _, parts in stretches(batch.column(0).to_pylist()):
                _count_words(counts, b"\n".join(parts).lower())
                size += sum(map(len, parts))
                if len(counts) > FLUSH or size > 64 * STRETCH:
                    yield out()
                    counts.clear()
                    size = 0
            counts[END_TOKEN] += len(batch)
        if counts:
            yield out()

    return save(train.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")), "token-counts")


def head_tokens(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent tokens that occur CODED_COUNT times, HEAD at most, in falling order."""
    short = counts.where((F.octet_length("token") <= HEAD_BYTES) & (F.col("token") != F.lit(END_TOKEN)) & (F.col("c") >= CODED_COUNT))
    # Counts are binned by sixteenths of a power of two: a bounded histogram.
    bins = short.groupBy(F.floor(F.log2("c") * 16).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.max("c").alias("top")).collect()
    least, n = None, 0
    for r in sorted(bins, key=lambda r: -r.b):
        n += r.n
        if n > HEAD:
            break
        least = r.c
    if least is None:
        least = max((r.top for r in bins), default=0) + 1
    found = short.where(F.col("c") >= least).toArrow()
    tokens, c = found.column("token").to_pylist(), found.column("c").to_numpy()
    order = sorted(range(len(tokens)), key=lambda k: (-c[k], tokens[k]))
    return [tokens[k] for k in order], c[order] if order else np.zeros(0, np.int64)


def _row(part: int, counts: np.ndarray) -> pa.RecordBatch:
    blob = zlib.compress(np.ascontiguousarray(counts, "<u4").tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "counts"])


def _parts(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, at in enumerate(range(0, sums.shape[1], PART)):
        if sums[:, at : at + PART].any():
            yield _row(part, sums[:, at : at + PART])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(zlib.decompress(blob), "<u4").reshape(2, -1).astype(np.uint64)
            held[part] = held[part] + found if part in held else found
    for part, found in held.items():
        # Counts over 2^31 are halved together, which keeps their ratio.
        while found.max() >= 1 << 31:
            found = found >> np.uint64(1)
        yield _row(part, found.astype("<u4"))


def _summed(made: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of all slots, from the tables that tasks have counted."""
    made = made.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), SALTS)
    level = made.repartition(parts, "part", "salt").select("part", "counts").mapInArrow(_merged, "part int, counts binary")
    whole = level.repartition(parts, "part").mapInArrow(_merged, "part int, counts binary")
    zeros, ones = np.zeros(slots, np.float32), np.zeros(slots, np.float32)
    # One row for each part of the bounded tables.
    for r in whole.collect():
        found = np.frombuffer(zlib.decompress(bytes(r.counts)), "<u4").reshape(2, -1)
        at = r.part * PART
        zeros[at : at + found.shape[1]], ones[at : at + found.shape[1]] = found
    return zeros, ones


def context_tables(train: DataFrame, coder_sent) -> Tables:
    """The word contexts, counted over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Coder = coder_sent.value
        counts, symbols, any_ = SlotCounts(int(coder.starts[-1])), np.zeros(len(coder.length), np.int64), False
        for batch in batches:
            texts = coder.read(batch.column(0).to_pylist())
            if not texts:
                continue
            any_ = True
            symbol, one, two, _ = _run_of(texts, coder)
            symbols += np.bincount(symbol, minlength=len(symbols))
            for a in range(0, len(symbol), LANE_TOKENS):
                part = slice(a, a + LANE_TOKENS)
                _, bit, slots = coder.bits(symbol[part], one[part], two[part])
                counts.add(bit, slots[1:])
        if any_:
            sums = counts.sums.reshape(-1, 2)
            # The nodes' own counts follow from those of the symbols.
            some = np.flatnonzero(symbols)
            none = np.zeros(len(some), np.uint32)
            token, bit, slots = coder.bits(some, none, none)
            np.add.at(sums, (slots[0], bit), symbols[some][token].astype(np.uint32))
            yield from _parts(np.ascontiguousarray(sums.T))

    return Tables(*_summed(train.mapInArrow(count, "part int, counts binary"), int(coder_sent.value.starts[-1])))


def letter_tables(tail: DataFrame) -> tuple[Speller, Tables]:
    """The byte contexts, counted over the distinct training tokens outside the head."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b" ".join([*batch.column(0).to_pylist(), b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(n, pa.int64())], names=["byte", "n"])

    byte_counts = np.zeros(256, np.int64)
    for r in tail.mapInArrow(histogram, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        byte_counts[r.byte] = r.n
    speller = Speller(byte_counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = SlotCounts(int(speller.starts[-1])), False
        for batch in batches:
            part, n = [], 0
            for t in batch.column(0).to_pylist():
                part.append(t)
                n += len(t)
                any_ = True
                if n > LANE_TOKENS:
                    counts.add(*speller.bits(part)[1:])
                    part, n = [], 0
            if part:
                counts.add(*speller.bits(part)[1:])
        if any_:
            yield from _parts(np.ascontiguousarray(counts.sums.reshape(-1, 2).T))

    return speller, Tables(*_summed(tail.mapInArrow(count, "part int, counts binary"), int(speller.starts[-1])))


def _repeats(scored: DataFrame) -> DataFrame:
    """(row, repeats) with (k, c, n, d) of each chunk k whose context other places share.

    c: how often training has the context with the chunk; n: with any chunk; d:
    with how many different chunks.
    """
    flat = scored.select("row", "train", F.explode("chunks").alias("x")).select("row", "train", "x.k", "x.context", "x.chunk", "x.m")
    # Only contexts that occur twice and in training go on; in most text they are few.
    met = flat.groupBy("context").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("train"), F.col("m")).otherwise(0)).alias("n")).where("rows > 1 and n > 0")
    flat = save(flat.join(save(met.select("context", "n"), "met-contexts").hint("merge"), "context"), "met-chunks")
    pairs = save(flat.groupBy("context", "chunk").agg(F.sum(F.when(F.col("train"), F.col("m")).otherwise(0)).alias("c")), "chunk-pairs")
    # Written first: else a context with many chunks is joined in the task that counts it.
    kinds = pairs.groupBy("context").agg(F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("d"))
    kinds = save(kinds, "chunk-kinds")
    counted = save(pairs.join(kinds.hint("merge"), "context"), "chunk-counts")
    found = flat.join(counted.hint("merge"), ["context", "chunk"])
    return found.groupBy("row").agg(F.collect_list(F.struct("k", "c", "n", "d")).alias("repeats"))


def score_texts(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    train = docs.where(usable).select(text_bytes(text_col).alias("text"))
    counts = token_counts(train)
    r = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("token") == F.lit(END_TOKEN), F.col("c"))).alias("ends"), F.sum(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total, distinct, ends = r.n or 0, r.v or 0, r.ends or 0
    head, head_counts = head_tokens(counts)
    coder = Coder(head, head_counts, total, ends)
    least = int(head_counts[-1]) if len(head) else 1 << 62
    outside = (F.col("token") != F.lit(END_TOKEN)) & ((F.col("c") < least) | (F.octet_length("token") > HEAD_BYTES))
    speller, letters = letter_tables(counts.where(outside).select("token"))
    # The share of new words among those outside the head, by Good and Turing.
    new = float(np.clip((r.once or 0) / max(1, coder.in_tail), 0.02, 0.9))
    model = Model(coder, context_tables(train, spark.sparkContext.broadcast(coder)), speller, letters, new)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    chunk_kind = pa.list_(pa.struct([("k", pa.int32()), ("context", pa.int64()), ("chunk", pa.int64()), ("m", pa.int32())]))
    tail_kind = pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int32()), ("bits", pa.float32())]))
    spec = f"row long, id {kind}, train boolean, n_bytes long, n_tokens long, head_known long, head_log double, bits binary, own binary, chunks array<struct<k:int,context:long,chunk:long,m:int>>, tail array<struct<token:binary,k:int,bits:float>>"
    log_end = float(np.log10(ends + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        log_count = np.log10(m.coder.counts + 0.5)
        for batch in batches:
            raw = batch.column(3).to_pylist()
            read = m.coder.read(raw)
            bits, spelt = m.score(read, batch.column(2).to_pylist())
            known = [t.place[t.place >= 0] for t in read]
            sums, owns, pieces, tails = [], [], [], []
            for t, b, s in zip(read, bits, spelt):
                start, context, chunk = chunks(t.hashed)
                sums.append(np.add.reduceat(b, np.concatenate([[0], start]), dtype=np.float64).astype("<f4").tobytes())
                own, rows = _own_chunks(context, chunk)
                owns.append(own)
                pieces.append(rows)
                k = np.searchsorted(start, np.flatnonzero(t.place < 0), side="right")
                tails.append((t.tail, k, s))
            columns = [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array([len(t) for t in raw], pa.int64()),
                pa.array([len(t.place) + 1 for t in read], pa.int64()),
                pa.array([len(k) + (ends > 0) for k in known], pa.int64()),
                pa.array([float(log_count[k].sum()) + log_end for k in known], pa.float64()),
                pa.array(sums, pa.binary()),
                pa.array(owns, pa.binary()),
                _lists(chunk_kind, [len(p[0]) for p in pieces], [np.concatenate(c) for c in zip(*pieces)]),
                _lists(tail_kind, [len(t[0]) for t in tails], [[w for t in tails for w in t[0]], np.concatenate([t[1] for t in tails]), np.concatenate([t[2] for t in tails])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "train", "n_bytes", "n_tokens", "head_known", "head_log", "bits", "own", "chunks", "tail"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(usable, F.lit(False)).alias("train"), text_bytes(text_col).alias("text"))
    scored = save(slim.mapInArrow(run, spec), "scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.k", "t.bits")
    looked = tail.join(counts, "token", "left").groupBy("row").agg(F.collect_list(F.struct("k", "bits", F.coalesce("c", F.lit(0)).alias("c"))).alias("tail"))
    out = scored.drop("tail", "chunks").join(save(looked, "tails"), "row", "left").join(save(_repeats(scored), "repeats"), "row", "left")
    log_all = float(np.log10(total + 0.5 * (distinct + 1)))
    in_tail = max(1, coder.in_tail)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            raw = get("bits").to_pylist()
            if not raw:
                continue
            size = np.array([len(x) // 4 for x in raw])
            begin, bits = np.cumsum(size) - size, np.frombuffer(b"".join(raw), "<f4").astype(float)
            row, (k, spelt, c) = _struct_lists(get("tail"))
            known = get("head_known").to_numpy() + np.bincount(row, c > 0, len(raw)).astype(np.int64)
            log = get("head_log").to_numpy() + np.bincount(row, np.log10(c + 0.5), len(raw))
            cost = np.where(c > 0, np.log2((1 - new) * np.maximum(c, 1) / in_tail), np.log2(new) + spelt)
            bits += np.bincount(begin[row] + k, cost, len(bits))
            row, found = _struct_lists(get("repeats"))
            ends = np.searchsorted(row, np.arange(len(raw) + 1))
            own, train = get("own"), get("train")
            for r in np.flatnonzero(np.diff(ends)).tolist():
                part, n = slice(begin[r] + 1, begin[r] + size[r]), size[r] - 1
                alike = np.frombuffer(own[r].as_py(), "<i4")
                alike = alike.reshape(3, -1) if len(alike) else np.stack([np.arange(n), np.ones(n, int), np.ones(n, int)])
                bits[part] = _copied(bits[part], alike, train[r].as_py(), *(f[ends[r] : ends[r + 1]] for f in found))
            score, base = np.add.reduceat(bits, begin) * float(np.log10(2)), log - get("n_tokens").to_numpy() * log_all
            yield pa.RecordBatch.from_arrays([get("id"), get("n_bytes"), get("n_tokens"), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=[id_col, "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    done = out.mapInArrow(finish, f"`{id_col}` {kind}, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return done.select(id_col, "n_bytes", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _own_chunks(context: np.ndarray, chunk: np.ndarray) -> tuple[bytes, tuple[np.ndarray, ...]]:
    """Of each chunk its first like, how often it comes and its context does; and the distinct ones as rows (k, context, chunk, m).

    No bytes for chunks whose contexts all differ.
    """
    n = len(context)
    if len(set(context.tolist())) == n:
        return b"", (np.arange(n, dtype=np.int32), context.view(np.int64), chunk.view(np.int64), np.ones(n, np.int32))
    _, first, like, m = np.unique(spread(context * np.uint64(3)) ^ chunk, return_index=True, return_inverse=True, return_counts=True)
    _, which, of_context = np.unique(context, return_inverse=True, return_counts=True)
    own = np.stack([first[like], m[like], of_context[which]]).astype("<i4")
    return own.tobytes(), (first.astype(np.int32), context[first].view(np.int64), chunk[first].view(np.int64), m.astype(np.int32))


def _copied(bits: np.ndarray, own: np.ndarray, train: bool, k: np.ndarray, c: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The bits of chunks with contexts that others share, as a mixture of copying and coding."""
    at = np.full(len(bits), -1)
    at[k] = np.arange(len(k))
    at = at[own[0]]
    some = np.flatnonzero(at >= 0)
    at = at[some]
    c, n, d = c[at].astype(float), n[at].astype(float), d[at].astype(float)
    if train:
        c, n = c - own[1][some], n - own[2][some]
        d -= c <= 0
    some, c, n, d = (v[n > 0] for v in (some, c, n, d))
    share = np.clip(DISCOUNT * np.maximum(d, 1) / n, 1e-3, 1)
    out = bits.copy()
    out[some] = np.logaddexp2(np.log2(np.maximum(c - DISCOUNT, 1e-300) / n), np.log2(share) + bits[some])
    return out


def _lists(kind: pa.DataType, sizes: list[int], columns: list) -> pa.Array:
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values).cast(kind)


def _struct_lists(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, fields) of all structs in the lists; a null list has none."""
    values = lists.flatten()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), [values.field(k).to_numpy(zero_copy_only=False) for k in range(values.type.num_fields)]
