"""Repeated word sequences found by recompression, and their removal.

A window is `window` consecutive words of one text; a word goes if a window covering it has a word sequence that
also starts anywhere else, in the same text or another.

1. Naming. Words are named by hashes. First each run of equal words becomes one symbol; then, in each of `ROUNDS`
   rounds, the symbols are split into left and right ones by a bit of their hash, and every left symbol
   followed by a right one becomes one symbol, named by the two. A name is a function of what it stands for,
   so equal stretches get equal names everywhere with nothing to agree on between tasks. Each symbol carries
   its support: the words that its name and borders depend on. Inside equal stretches symbols with their
   support inside are equal; only those at the ends may differ.
2. Revealing. Of the sequences of `TUPLE` high-level symbols, the one with the smallest hash of every `SPAN`
   neighbours is kept, its support widened by the others'. Names are counted over all texts (combined before
   the shuffle). A name that occurs once proves, for every window holding its support, that the window does
   not occur elsewhere. A window that no such name rules out is a candidate.
3. Verifying. Candidates are hashed whole and counted; those that occur once are ruled out too. What is left
   is exactly the repeated windows (of 64-bit hashes of their words).

Step 2 only ever rules out windows that are proven to be single, so its settings and runs of equal words, whose
symbols have no bounded support, change the work but not the result. Copies and hot passages meet in counts,
never in lists or pairs; what goes back to a text is what it has alone.

Defined results: null text has no words; texts shorter than a window lose nothing by it (they may still hold
none); rows that repeat an id and text count as two places, so long ones lose all their words; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialise, release

WINDOW = 35
ROUNDS = 3
TUPLE = 3
SPAN = 4
#: Tables of a row per text with candidates are broadcast up to this many rows and numbers in them.
BROADCAST_ROWS, BROADCAST_NUMBERS = 1_000_000, 8_000_000

_FAR = 1 << 40


class Symbols:
    """Symbols of a run of texts: names, texts, and supports in words (`lo` >= -1: whole; else unknown)."""

    def __init__(self, w: K.Words):
        h, doc = w.hashes(), w.doc_of_word()
        n = len(h)
        new = np.ones(n, dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        self.name = K.mix(h[first] + np.minimum(size, 3).astype(np.uint64) * np.uint64(0x51ED27))
        self.doc = doc[first]
        # That a run ends shows in the words beside it; before a text's first word anything might stand.
        self.lo, self.hi = first - 1, first + size + 1
        self.lo[self.lo < w.first[self.doc]] = -_FAR
        self.hi[self.hi > w.first[self.doc + 1]] = _FAR
        self.lo[size > 2], self.hi[size > 2] = -_FAR, _FAR

    def pair(self, seed: int) -> None:
        """One round: left symbols join the right ones behind them."""
        n = len(self.name)
        if not n:
            return
        right = (K.mix(self.name ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
        same = np.zeros(n, dtype=bool)
        same[:-1] = self.doc[1:] == self.doc[:-1]
        join = np.zeros(n, dtype=bool)
        join[:-1] = same[:-1] & ~right[:-1] & right[1:]
        taken = np.zeros(n, dtype=bool)
        taken[1:] = join[:-1]
        lo, hi = self.lo.copy(), self.hi.copy()
        # A left symbol stays alone because of the one behind it, a right one because of the one before.
        left_alone, right_alone = ~right & ~join, right & ~taken
        behind = np.append(np.where(same[:-1], self.hi[1:], _FAR), _FAR)
        before = np.append(-_FAR, np.where(same[:-1], self.lo[:-1], -_FAR))
        hi = np.where(left_alone, np.maximum(hi, behind), hi)
        lo = np.where(right_alone, np.minimum(lo, before), lo)
        at = np.flatnonzero(join)
        hi[at] = np.maximum(self.hi[at], self.hi[at + 1])
        lo[at] = np.minimum(self.lo[at], self.lo[at + 1])
        name = self.name.copy()
        name[at] = K.mix(self.name[at] * np.uint64(0xD1342543DE82EF95) + K.mix(self.name[at + 1] + np.uint64(seed)))
        keep = ~taken
        self.name, self.doc, self.lo, self.hi = name[keep], self.doc[keep], lo[keep], hi[keep]


def anchors(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept names, their texts, and the first and last start of the windows (in the text) that hold all
    that the name and its choice depend on."""
    s = Symbols(w)
    for r in range(ROUNDS):
        s.pair(r + 1)
    none = np.zeros(0, np.int64)
    m = len(s.name) - TUPLE + 1
    if m < SPAN:
        return none.astype(np.uint64), none, none, none
    name, lo, hi = np.zeros(m, np.uint64), s.lo[:m].copy(), s.hi[:m].copy()
    for i in range(TUPLE):
        name = name * np.uint64(0xD1342543DE82EF95) + s.name[i : i + m]
        lo, hi = np.minimum(lo, s.lo[i : i + m]), np.maximum(hi, s.hi[i : i + m])
    name = K.mix(name)
    t = m - SPAN + 1
    around = np.stack([name[i : i + t] for i in range(SPAN)])
    best = np.arange(t) + around.argmin(axis=0)
    low, high = lo[:t].copy(), hi[:t].copy()
    for i in range(1, SPAN):
        low, high = np.minimum(low, lo[i : i + t]), np.maximum(high, hi[i : i + t])
    doc = s.doc[:t]
    good = (doc == s.doc[SPAN + TUPLE - 2 :]) & (high - low <= window)
    best, low, high, doc = best[good], low[good], high[good], doc[good]
    if not len(best):
        return none.astype(np.uint64), none, none, none
    # One name may win several spans; keep the one that says most.
    key = ((high - low) << 32) + np.arange(len(best))
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    pick = np.minimum.reduceat(key, first) & 0xFFFFFFFF
    best, low, high, doc = best[pick], low[pick], high[pick], doc[pick]
    base = w.first[doc]
    return name[best], doc, np.maximum(high - base - window, 0), low - base


def _name_rows(docs: DataFrame, text: str, window: int) -> DataFrame:
    """`h`, `key`, `span`: a row per kept name, and one per text of a window's length with minus its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b in K.pieces(batch.column(1)):
                w = K.Words(batch.column(1)[a:b])
                name, doc, low, high = anchors(w, window)
                of_long = w.counts[doc] >= window
                name, doc, low, high = name[of_long], doc[of_long], low[of_long], high[of_long]
                key = keys[a:b]
                long = np.flatnonzero(w.counts >= window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([name.view(np.int64), K.mix(key[long].view(np.uint64)).view(np.int64)])),
                        pa.array(np.concatenate([key[doc], key[long]])),
                        pa.array(np.concatenate([(low << 32) + high, -w.counts[long]])),
                    ],
                    names=["h", "key", "span"],
                )

    return docs.select(_key(docs, text), text).mapInArrow(run, "h bigint, key bigint, span bigint")


def _key(docs: DataFrame, text: str, id_col: str = "doc_id"):
    return F.xxhash64(F.col(id_col), F.col(text)).alias("key")


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of set places, in turn."""
    steps = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1).ravel().tolist()


def _spread(runs: list[int], size: int) -> np.ndarray:
    out = np.zeros(size, dtype=bool)
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out[a:b] = True
    return out


def _candidates(window: int):
    @F.arrow_udf("array<int>")
    def udf(spans: pa.Array) -> pa.Array:
        out = []
        for row in spans:
            v = np.array(row.as_py(), np.int64)
            n = int(-v.min()) - window + 1
            v = v[v >= 0]
            steps = np.zeros(n + 1, np.int64)
            low, high = np.minimum(v >> 32, n), np.clip((v & 0xFFFFFFFF) + 1, 0, n)
            full = low < high
            np.add.at(steps, low[full], 1)
            np.add.at(steps, high[full], -1)
            out.append(_runs(np.cumsum(steps[:-1]) == 0))
        return pa.array(out, pa.list_(pa.int32()))

    return udf


def _without():
    """The runs less the single places."""

    @F.arrow_udf("array<int>")
    def udf(runs: pa.Array, single: pa.Array) -> pa.Array:
        out = []
        for r, s in zip(runs.to_pylist(), single.to_pylist(), strict=True):
            flags = _spread(r, r[-1])
            flags[s or []] = False
            out.append(_runs(flags))
        return pa.array(out, pa.list_(pa.int32()))

    return udf


def _small(table: DataFrame, numbers: str) -> DataFrame:
    """`table` marked for broadcast if its rows and numbers are few enough."""
    rows, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and total <= BROADCAST_NUMBERS else table


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`key` (hash of id and text) and `runs`: starts and ends of runs of repeated windows' first words."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    names = _name_rows(d, "t", window)
    alone = (
        names.groupBy("h")
        .agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key"), F.min("span").alias("span"))
        .where("c = 1 OR span < 0")
    )
    spans = alone.groupBy("key").agg(F.collect_list("span").alias("spans")).withColumn("runs", _candidates(window)("spans"))
    cand = materialise(spans.select("key", "runs").where(F.size("runs") > 0), "repeat-candidates")
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, runs = batch.column(0).to_numpy(), batch.column(2)
            for a, b in K.pieces(batch.column(1)):
                w = K.Words(batch.column(1)[a:b])
                hashes, owner, start = [], [], []
                whole = K.Prefix(w.hashes())
                for i in range(a, b):
                    at = np.flatnonzero(_spread(runs[i].as_py(), int(w.counts[i - a]) + 1))
                    place = w.first[i - a] + at
                    hashes.append(whole.hash(place, place + window).view(np.int64))
                    owner.append(np.full(len(at), keys[i]))
                    start.append(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (hashes, owner, start)], names=["h", "key", "start"]
                )

    texts = d.select(_key(d, "t"), "t").join(_small(cand, "runs"), "key").select("key", "t", "runs")
    windows = texts.mapInArrow(run, "h bigint, key bigint, start bigint")
    single = (
        windows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key"), F.min("start").alias("start"))
        .where("c = 1")
        .groupBy("key")
        .agg(F.collect_list("start").alias("single"))
    )
    left = cand.join(single, "key", "left").select("key", _without()("runs", "single").alias("runs"))
    out = materialise(left.where(F.size("runs") > 0), "repeats")
    release(docs.sparkSession)
    return out


def _without_repeats(texts: pa.Array, runs: pa.Array, window: int) -> tuple[list, list, list]:
    """Words, words removed, and the text of the words that stay, of each text of a piece."""
    words, removed, kept = [], [], []
    w = K.Words(texts)
    for i in range(w.docs):
        first, last = int(w.first[i]), int(w.first[i + 1])
        gone = np.zeros(last - first, dtype=bool)
        r = runs[i].as_py() or []
        for s, e in zip(r[::2], r[1::2], strict=True):
            gone[s : e + window - 1] = True
        stay = np.flatnonzero(~gone) + first
        size = w.end[stay] - w.start[stay] + 1
        before = np.cumsum(size) - size
        total = int(size.sum())
        source = np.repeat(w.start[stay] - before, size) + np.arange(total)
        joined = w.data[np.minimum(source, len(w.data) - 1)].copy() if total else np.zeros(0, np.uint8)
        joined[before + size - 1] = 32
        words.append(last - first)
        removed.append(int(gone.sum()))
        kept.append(joined[:-1].tobytes().decode() if total else "")
    return words, removed, kept


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Every document: id, `n_words`, `n_removed`, and `kept`, the words that stay joined by one space."""
    found = repeated_windows(docs, id_col, text, window)
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.xxhash64(id_col, text).alias("key"))
    joined = d.join(_small(found, "runs"), "key", "left").select("id", "t", "runs")
    names = [id_col, "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.pieces(batch.column(1)):
                words, removed, kept = _without_repeats(batch.column(1)[a:b], batch.column(2)[a:b], window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=names,
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")
