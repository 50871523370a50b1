"""Periodic runs: stretches of words that repeat with a period, at least four times over.

A run is a stretch with smallest period q and at least max(6, 4 q) words that no neighbouring word extends.

Longest common extensions (LCE) of two places come from a difference cover: of all suffixes only those that
start at places whose remainder by 21 is in the cover are sorted (blocks of 21 words first, then by doubling).
From any two places at most 20 words are compared until both are at sampled ones; the rest is a range minimum
over the common prefixes of neighbours in the sorted order, from a sparse table.

Runs are found on harmonic grids. A run of period q is a stretch of at least max(6 - q, 3 q) places whose word
equals the one q further on; so of the places 0, s, 2 s, ... with that s, one is in it. All periods together
probe a number of places in proportion to n log n. From a probe that matches, the LCE gives the stretch's end;
its start is found going back a few words, then by bisection with LCEs. Of stretches with the same ends the
smallest period counts.

Words are compared exactly (as numbers of the distinct words of a piece of about half a MiB of texts). Every
text is worked on whole, inside one task: memory is some 150 bytes for each word of the longest text.

Defined results: null or empty texts have no runs and an empty collapsed text; repeated rows give equal rows;
an empty table gives an empty result; the other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .common import free_name

MIN_WORDS, MIN_PERIODS = 6, 4
PIECE_BYTES = 512 << 10
#: Probes worked on at once.
PROBES = 2_000_000

#: A perfect difference cover: every remainder is the difference of two of its members.
MODULUS = 21
COVER = (0, 1, 4, 14, 16)

_member = np.isin(np.arange(MODULUS), COVER)
_place = np.cumsum(_member) - 1
#: Words to the first offset at which two places with remainder r and distance g are both sampled.
_shift = np.array(
    [
        [
            next(d for d in range(MODULUS) if _member[(r + d) % MODULUS] and _member[(r + g + d) % MODULUS])
            for g in range(MODULUS)
        ]
        for r in range(MODULUS)
    ]
)


class Extensions:
    """LCE queries over a sequence of numbers whose last one occurs nowhere else."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, per = len(x), len(COVER)
        self.places = np.flatnonzero(np.resize(_member, n))
        m = len(self.places)
        kind = ">u2" if x.max(initial=0) < 65_534 else ">u4"
        padded = np.concatenate([x + 1, np.zeros(MODULUS, x.dtype)]).astype(kind)
        blocks = np.lib.stride_tricks.sliding_window_view(padded, MODULUS)[self.places]
        rows = np.ascontiguousarray(blocks).view(f"V{blocks.dtype.itemsize * MODULUS}").ravel()
        order = np.argsort(rows, kind="stable")
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], rows[order][1:] != rows[order][:-1]]))
        levels, step = [], per
        while rank.max(initial=0) + 1 < m:
            levels.append(rank.astype(np.int32))
            ahead = np.zeros(m, dtype=np.int64)
            ahead[: max(m - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (m + 1) + ahead, return_inverse=True)[1]
            step *= 2
        self.rank = rank
        order = np.empty(m, dtype=np.int64)
        order[rank] = np.arange(m)
        # Common prefixes of neighbours: whole blocks by the levels of the doubling, then words.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
            common += np.where(same, MODULUS << k, 0)
            a += np.where(same, per << k, 0)
            b += np.where(same, per << k, 0)
        live = np.flatnonzero((a < m) & (b < m))
        pa_, pb = self.places[a[live]], self.places[b[live]]
        t = 0
        while len(live):
            inside = (pa_ + t < n) & (pb + t < n)
            same = inside & (x[np.where(inside, pa_ + t, 0)] == x[np.where(inside, pb + t, 0)])
            common[live[same]] += 1
            live, pa_, pb, t = live[same], pa_[same], pb[same], t + 1
        table = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.table = table

    def _sampled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        per = len(COVER)
        ra, rb = (self.rank[p // MODULUS * per + _place[p % MODULUS]] for p in (a, b))
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        return out

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal numbers from places `a` and `b` on (a < b, element by element)."""
        shift = _shift[a % MODULUS, (b - a) % MODULUS]
        out = shift.astype(np.int64)
        reached = np.ones(len(a), dtype=bool)
        live, t = np.flatnonzero(shift > 0), 0
        while len(live):
            same = self.x[a[live] + t] == self.x[b[live] + t]
            ended = live[~same]
            out[ended], reached[ended] = t, False
            t += 1
            live = live[same]
            live = live[shift[live] > t]
        at = np.flatnonzero(reached)
        if len(at):
            out[at] += self._sampled(a[at] + shift[at], b[at] + shift[at])
        return out


def _stretches(ext: Extensions, base: np.ndarray, q: np.ndarray, grid: np.ndarray, i: np.ndarray):
    """(which, start, end) of the stretches that hold a grid place; all arguments by probe.

    `base` is where the probe's text begins, `i` its place in the text; one stretch of a (text, period) is
    met by consecutive probes, the first of which counts.
    """
    x = ext.x
    a = base + i
    at = np.flatnonzero(x[a] == x[a + q])
    end = i[at] + ext.lce(a[at], a[at] + q[at])
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (base[at][1:] == base[at][:-1]) & (q[at][1:] == q[at][:-1]) & (end[1:] == end[:-1])
    at, end = at[~again], end[~again]
    start = i[at].copy()
    live = np.arange(len(at))
    for _ in range(MODULUS):
        live = live[start[live] > 0]
        p = base[at[live]] + start[live] - 1
        live = live[x[p] == x[p + q[at[live]]]]
        start[live] -= 1
    low = np.maximum(i[at[live]] - grid[at[live]] + 1, 0)
    high = start[live].copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        mid = (low[open_] + high[open_]) // 2
        w = at[live[open_]]
        reach = mid + ext.lce(base[w] + mid, base[w] + mid + q[w]) >= end[live[open_]]
        high[open_[reach]] = mid[reach]
        low[open_[~reach]] = mid[~reach] + 1
    start[live] = high
    return at, start, end


def find_runs(x: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all runs, by text, start and period.

    `x` holds the texts' words as numbers, each text followed by a number of its own; text d has `n[d]` words
    from `base[d]` on.
    """
    texts = np.flatnonzero(n >= MIN_WORDS)
    found = []
    if len(texts):
        ext = Extensions(x)
        most = n[texts] // MIN_PERIODS
        doc = np.repeat(texts, most)
        q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
        grid = np.maximum(MIN_WORDS - q, (MIN_PERIODS - 1) * q)
        probes = -(-(n[doc] - q) // grid)
        upto = np.cumsum(probes)
        s = 0
        while s < len(doc):
            e = max(int(np.searchsorted(upto, upto[s] - probes[s] + PROBES, side="right")), s + 1)
            part = np.arange(s, e)
            which = np.repeat(part, probes[part])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(probes[part]) - probes[part], probes[part])
            i = nth * grid[which]
            at, start, end = _stretches(ext, base[doc[which]], q[which], grid[which], i)
            which = which[at]
            ok = end - start >= grid[which]
            which, start, end = which[ok], start[ok], end[ok]
            found.append(np.stack([doc[which], start, end - start + q[which], q[which]]))
            s = e
    d, start, length, period = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    order = np.lexsort((period, length, start, d))
    d, start, length, period = d[order], start[order], length[order], period[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    d, start, length, period = d[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, d))
    return d[order], start[order], length[order], period[order]


def _collapsed(w: K.Words, d, start, length, period) -> pa.Array:
    """The words that no run holds behind its first period, joined by one space."""
    steps = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(steps, w.first[d] + start + period, 1)
    np.add.at(steps, w.first[d] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    doc = np.searchsorted(w.first, kept, side="right") - 1
    size = w.end[kept] - w.start[kept]
    # A space behind every word but the last one of a text.
    gap = np.zeros(len(kept), dtype=np.int64)
    gap[:-1] = doc[1:] == doc[:-1]
    to = np.cumsum(size + gap)
    begin = to - size - gap
    out = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + inner] = w.data[np.repeat(w.start[kept], size) + inner]
    total = np.bincount(doc, weights=size + gap, minlength=w.docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(total)])
    return pa.LargeStringArray.from_buffers(w.docs, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _piece(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    w = K.Words(texts)
    size = w.end - w.start
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w.data[w.inside]))]
    ).dictionary_encode()
    base = w.first[:-1] + np.arange(w.docs)
    x = np.empty(len(size) + w.docs, dtype=np.int64)
    ends = base + w.counts
    inside = np.ones(len(x), dtype=bool)
    inside[ends] = False
    x[inside] = words.indices.to_numpy(zero_copy_only=False)
    x[ends] = len(words.dictionary) + np.arange(w.docs)
    d, start, length, period = find_runs(x, base, w.counts)
    runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
    cut = np.searchsorted(d, np.arange(w.docs + 1)).astype(np.int32)
    return pa.array(w.counts), pa.ListArray.from_arrays(pa.array(cut), runs), _collapsed(w, d, start, length, period)


def runs(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str, str]:
    """`docs` with `n_words`, `runs` (start, length and period, by start and period) and `collapsed`: the text
    with each run cut down to its first period. Their names are returned, as they avoid those of `docs`."""
    names = [free_name(docs, c) for c in ("n_words", "runs", "collapsed")]
    run = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])
    kinds = [T.LongType(), T.ArrayType(run), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]])
    place = docs.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.pieces(batch.column(place), PIECE_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *_piece(part.column(place))], names=schema.names)

    return docs.mapInArrow(find, schema), *names
