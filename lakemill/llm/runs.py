"""Words of many texts at once, in numpy: where they are, and hashes of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are read at once.
STRETCH = 1 << 22

_SPACE = re.compile(rb"[ \t-\r]")
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


class Polynomial:
    """Hashes of runs of 64-bit values: polynomials modulo 2^64, whatever the run's place."""

    def __init__(self, base: int, seed: int) -> None:
        self.base = base
        self.byte = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            made = []
            for base in (self.base, pow(self.base, -1, 1 << 64)):
                steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            self.power, self.inverse = made

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run start .. end - 1 of the values."""
        self._grow(len(values))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=total[1:])
        return spread((total[end] - total[start]) * self.inverse[start])

    def words(self, line: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of bytes."""
        return self.runs(self.byte[line], start, end)


#: Two that are independent, for 128 bits together.
FIRST = Polynomial(0x9E3779B97F4A7C15, 11)
SECOND = Polynomial(0xD1342543DE82EF95, 12)


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def spans(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word ``[^\\x20\\x09-\\x0D]+`` of a line of bytes."""
    space = (line == 32) | (line - np.uint8(9) < 5)
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edges[::2], edges[1::2]


def stretches(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts or, at white space, parts of them, of STRETCH bytes together: (which text, part).

    The parts of a text come in order.  A part of more than STRETCH bytes stands
    alone and is one word.
    """
    which: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > STRETCH:
            cut = max(text.rfind(c, at, at + STRETCH) for c in _SPACES)
            if cut < 0:
                far = _SPACE.search(text, at + STRETCH)
                cut = far.start() if far else len(text)
            if parts:
                yield which, parts
                which, parts, size = [], [], 0
            yield [k], [text[at:cut]]
            at = cut + 1
        if parts and size + len(text) - at > STRETCH:
            yield which, parts
            which, parts, size = [], [], 0
        which.append(k)
        parts.append(text[at:] if at else text)
        size += len(text) - at + 1
    if parts:
        yield which, parts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the hashes of its words, A-Z in lower case."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for which, parts in stretches(texts):
        if len(parts[0]) > STRETCH:
            out[which[0]].append(np.array([xxhash.xxh64_intdigest(parts[0].lower())], np.uint64))
            continue
        line = np.frombuffer(b"\n".join(parts).lower(), np.uint8)
        start, end = spans(line)
        cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in parts[:-1]]))
        for k, found in zip(which, np.split(FIRST.words(line, start, end), cuts)):
            out[k].append(found)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def shingle_kinds(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Of each text the different hashes of its runs of shingle words, in order; of all its words if it has fewer."""
    out = []
    for h in word_hashes(texts):
        at = np.arange(max(min(1, len(h)), len(h) - shingle + 1))
        out.append(np.unique(FIRST.runs(h, at, np.minimum(at + shingle, len(h)))))
    return out
