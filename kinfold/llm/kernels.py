"""NumPy kernels over Arrow text: word cutting and window hashing for a whole batch at once.

No loop runs over words or characters. A hash of any stretch of bytes (or words) comes from one
prefix sum of a polynomial modulo 2**64, then a bit mixer. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

# The bytes \x20 and \x09-\x0D part words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and doubled when a longer one is asked for."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Polynomial prefix sums; `hash(s, e)` depends only on the values in [s, e)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(values.astype(np.uint64) * _power(_BASE, n)[:n], out=self.sums[1:])
        self.back = _power(_INVERSE, n)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * _GOLD)


class Words:
    """The words of a run of texts, as positions in one byte array.

    data      bytes of all texts, one after the other
    offsets   where each text begins in `data` (one more than there are texts)
    start,end of every word; words never cross texts
    first     index of the first word of each text (one more than there are texts)
    """

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE):
        self.offsets, data = text_bytes(texts)
        self.data = LOWER[data] if lower else data
        inside = ~space[self.data]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            before[cut] = False
            after[cut - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    @cached_property
    def bytes(self) -> Prefix:
        return Prefix(self.data + np.uint64(1)) if len(self.data) else Prefix(np.zeros(0, np.uint64))

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        return self.bytes.hash(self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if buffers[2] is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, so that working memory doesn't follow the batch size."""
    offsets, _ = text_bytes(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and text of every run of `k` words inside one text."""
    room = np.maximum(np.diff(first) - k + 1, 0)
    total = int(room.sum())
    doc = np.repeat(np.arange(len(room)), room)
    base = np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    return base + np.arange(total), doc


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of `n` places lie in [s, s + length) for some start s."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur at least twice."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `flags` over the stretches given by `first`."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[first])
