"""Vectorised scanning of a batch of texts: words, word hashes and shingles.

A word is a maximal run of characters other than space and the control
characters 9 to 13, with A-Z lower-cased.  A whole Arrow batch is scanned as one
flat byte array, so there is no loop over rows or words.  Null and empty texts
have no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _letters() -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    codes[65:91] += U64(32)
    return mix(codes, 7)


LETTER = _letters()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=U64)
    with np.errstate(over="ignore"):
        out[1:] = U64(base)
        return np.multiply.accumulate(out)


_POWER: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWER.get(base)
    if have is None or len(have) < n:
        have = _POWER[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


@dataclass
class Words:
    """start, end: byte offsets of each word in data; row: its text; first: the index of each text's first word, one more at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with one space after each, and the offset of each text (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.full(len(raw) + n, 32, dtype=np.uint8)
    keep = np.ones(len(data), dtype=bool)
    keep[offsets[1:] + np.arange(n)] = False
    data[keep] = raw
    return data, offsets + np.arange(n + 1)


#: Bytes hashed at a time, so that memory follows the block and not the text.
BLOCK = 1 << 16


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Slices of a batch whose texts hold about ``most`` bytes; a longer text comes alone."""
    if not batch.num_rows:
        return
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, min(to, at + 16384, batch.num_rows) - at)
        at = min(to, at + 16384, batch.num_rows)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letter: np.ndarray = LETTER) -> np.ndarray:
    """64-bit hashes of the byte stretches from start to end (ascending, apart), with a number for each byte value."""
    out = np.zeros(len(start), dtype=U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
            low, high = int(start[at]), int(end[to - 1])
            sums = np.zeros(high - low + 1, dtype=U64)
            np.cumsum(letter[data[low:high]] * powers(BASE, high - low), out=sums[1:])
            s, e = start[at:to] - low, end[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * powers(INVERSE, high - low + 1)[s] + (e - s).astype(U64))
            at = to
    return out


def scan(texts: pa.Array) -> Words:
    data, offsets = flat(texts)
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(WHITE[data], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, row, first, hashes(data, start, end))


def grams(words: Words, n: int) -> np.ndarray:
    """For each word, the hash of the n words that begin there (only meaningful where they end in the same text)."""
    h = words.hash
    out = np.zeros(len(h), dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(h))):
            out[: len(h) - k] += mix(h[k:], k + 1)
        return mix(out)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(count per text, hashes) of the distinct shingles of n words of each text, sorted within the text; a shorter text has its whole sequence as one."""
    count, h, first = np.diff(words.first), words.hash, words.first
    every, sizes, out = grams(words, n), np.zeros(len(count), dtype=np.int64), []
    for r in np.flatnonzero(count):
        a, b = first[r], first[r + 1]
        if count[r] >= n:
            own = np.sort(every[a : b - n + 1])
            new = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        else:
            with np.errstate(over="ignore"):
                own = mix(np.array([sum(int(mix(h[a + k : a + k + 1], k + 1)[0]) for k in range(b - a)) & (2**64 - 1)], dtype=U64), int(b - a))
        sizes[r] = len(own)
        out.append(own)
    return sizes, np.concatenate(out) if out else np.zeros(0, dtype=U64)


class Index:
    """Numbers of 64-bit hashes, in an open-addressed table that doubles when it is half full."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, dtype=U64), np.full(1 << bits, -1, dtype=np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        place = (h >> U64(64 - self.bits)).astype(np.int64)
        out = self.numbers[place]
        left = np.flatnonzero((self.keys[place] != h) & (out >= 0))
        place = place[left]
        while len(left):
            place = place + 1 & (1 << self.bits) - 1
            found, same = self.numbers[place], self.keys[place] == h[left]
            out[left] = np.where(same, found, -1)
            on = (found >= 0) & ~same
            left, place = left[on], place[on]
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Numbers (0 or more) of distinct hashes that have none yet."""
        self.size += len(h)
        if 2 * self.size > 1 << self.bits:
            old, had = self.keys[self.numbers >= 0], self.numbers[self.numbers >= 0]
            self.bits = (2 * self.size).bit_length()
            self.keys, self.numbers = np.zeros(1 << self.bits, dtype=U64), np.full(1 << self.bits, -1, dtype=np.int32)
            self._put(old, had)
        self._put(h, numbers)

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        place = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.numbers[place] < 0
            self.keys[place[free]] = h[free]
            won = free & (self.keys[place] == h)  # of several for one place the last
            self.numbers[place[won]] = numbers[won]
            h, numbers, place = h[~won], numbers[~won], place[~won] + 1 & (1 << self.bits) - 1


class Store:
    """Runs of numbers, one after another; room grows by doubling."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 12, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.flat):
            room = np.zeros(2 * (self.used + len(more)), dtype=self.flat.dtype)
            room[: self.used] = self.flat[: self.used]
            self.flat = room
        self.flat[self.used : self.used + len(more)] = more
        self.used += len(more)
