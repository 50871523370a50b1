"""Scoring of texts by prediction by partial matching over bytes, beside a word-count baseline.

A text is scored as its tokens: lower-cased (A-Z) words, each followed by a space, then one line feed for the end. The
model is a trie of byte contexts up to `ORDER` bytes with the counts of what followed them in the learning
texts. A symbol is coded in the longest known context; if it did not follow there, an escape is coded and the
next shorter context tried, without the symbols already ruled out (exclusion); after the empty context come
the bytes that never occurred, all alike. Escapes are estimated as in method C: a context with counts of sum T
over d symbols gives a symbol of count c the probability c / (T + d) and the escape d / (T + d).

As a context's symbols are among those of its suffix, what exclusion takes from the suffix's T and d depends
on the context alone. The trie is therefore compiled into flat tables (pair -> count, context -> T, d, and
T', d' of the suffix after exclusion), and a whole batch of bytes is coded by table look-ups, order by order.

In Spark: tasks count byte strings of ORDER + 1 bytes and words over all learning texts; the counts are summed
by shuffle, and those of shorter contexts are sums of longer ones. No string is left out. A symbol's probability
depends on its ORDER context bytes and itself alone, so texts meet their probabilities by that string: workers
hold the commonest strings (at most `MAX_NODES`, some 60 bytes each) with probabilities from the whole counts;
each other distinct string is coded once, by the task that has all counts of contexts with its last bytes, and
meets its texts by a join. Word counts go the same way: the commonest words (at most `COMMON_WORDS`) are
broadcast, all others meet their texts by a join.

Defined results: null text is empty (its end alone); rows with a null id are scored and never learned from,
and count as held out; repeated rows are scored, and learned from, once each; an empty table gives an empty
result; without any learning text every byte has 1/256. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_filesystem, materialise, write_table

ORDER = 5
MAX_NODES = 2_000_000
COMMON_WORDS = 1 << 20
HELD_OUT = (7, 2)

_END = np.uint64(0x656E64)  # the end's key among words; a word's key is a mixed hash
_WORD, _GRAM = 0, 1
_FLUSH = 2_000_000
#: Bytes of text worked on at a time; each takes some 60 bytes of memory on the way.
_PIECE = 1 << 19
#: Distinct strings of a task that looks up the strings no worker holds; each takes some 150 bytes.
_TASK_STRINGS = 500_000


def canonical(w: K.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the token sequences, each behind `order` line feeds, and the offsets of the texts (with
    those line feeds)."""
    sizes = w.end - w.start + 1
    per_doc = np.zeros(w.docs, np.int64)
    np.add.at(per_doc, w.doc_of_word(), sizes)
    offsets = np.concatenate([[0], np.cumsum(per_doc + order + 1)])
    out = np.full(int(offsets[-1]), 10, np.uint8)
    before = np.cumsum(sizes) - sizes
    first = np.zeros(w.docs, np.int64)
    some = w.counts > 0
    first[some] = before[w.first[:-1][some]]
    doc = w.doc_of_word()
    begin = offsets[doc] + order + before - first[doc]
    place = np.repeat(begin - before, sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(w.start - before, sizes) + np.arange(int(sizes.sum()))
    ends = begin + sizes - 1
    values = w.data[np.minimum(source, max(len(w.data) - 1, 0))] if len(w.data) else w.data
    out[place] = values
    out[ends] = 32
    return out, offsets


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol, its context and itself as one number; and the offsets by text."""
    key = np.zeros(len(data), np.uint64)
    for back in range(order, -1, -1):
        key <<= np.uint64(8)
        key[back:] |= data[: len(data) - back]
    symbol = np.ones(len(data), dtype=bool)
    for i in range(order):
        symbol[offsets[:-1] + i] = False
    cuts = offsets - order * np.arange(len(offsets))
    return key[symbol], cuts


def count_all(docs: DataFrame, text: str, order: int) -> DataFrame:
    """`kind`, `key`, `count` of words and of byte strings over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {_WORD: [], _GRAM: []}
        size, ends = 0, 0

        def fold(kind):
            keys = np.concatenate([k for k, _ in held[kind]])
            weights = np.concatenate([n for _, n in held[kind]])
            order_ = np.argsort(keys)
            keys, weights = keys[order_], weights[order_]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[kind] = [(keys[first], np.add.reduceat(weights, first))]

        def rows():
            for kind, parts in held.items():
                if parts:
                    fold(kind)
                    keys, counts = held[kind][0]
                    for s in range(0, len(keys), 100_000):
                        part = keys[s : s + 100_000]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(part), kind, np.int8)),
                                pa.array(part.view(np.int64)),
                                pa.array(counts[s : s + 100_000]),
                            ],
                            names=["kind", "key", "count"],
                        )

        for batch in batches:
            for a, b in K.pieces(batch.column(0), _PIECE):
                w = K.Words(batch.column(0)[a:b], lower=True)
                g, _ = grams(*canonical(w, order), order)
                ends += b - a
                for kind, keys in ((_WORD, w.hashes()), (_GRAM, g)):
                    if len(keys):
                        held[kind].append(np.unique(keys, return_counts=True))
                        size += len(held[kind][-1][0])
                if size > _FLUSH:
                    for kind in held:
                        fold(kind)
                    size = sum(len(p[0][0]) for p in held.values() if p)
                    if size > _FLUSH // 2:
                        yield from rows()
                        held, size = {_WORD: [], _GRAM: []}, 0
        if ends:
            held[_WORD].append((np.array([_END]), np.array([ends], np.int64)))
            yield from rows()

    return (
        docs.select(text)
        .mapInArrow(run, "kind tinyint, key bigint, count bigint")
        .groupBy("kind", "key")
        .agg(F.sum("count").alias("count"))
    )


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most `most` rows have it or more (by a histogram of few rows)."""
    step = F.floor(F.log2("count") * 16).cast("int")
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("top")).collect()
    left, least = most, 1
    for r in sorted(rows, key=lambda r: -r["step"]):
        if r["n"] > left:
            return int(r["top"]) + 1
        left -= r["n"]
    return least


def split_order(order: int) -> int:
    """The orders below it are whole in every worker; those from it on are dealt by that many context bytes."""
    return min(order, 3)


def low_orders(strings: DataFrame, order: int) -> str:
    """Write the byte strings of the orders below `split_order` (`j`, `key`, `count`; at most 256 ** 3 of an
    order, whatever the corpus) and return the folder."""
    out, level = None, strings
    for j in range(split_order(order) - 1, -1, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1))
        level = materialise(level.groupBy(suffix.alias("key")).agg(F.sum("count").alias("count")), "ppm-order")
        part = level.select(F.lit(j).alias("j"), "key", "count")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = strings.limit(0).select(F.lit(0).alias("j"), "key", "count")
    return write_table(out, "ppm-low")


def common_strings(strings: DataFrame, most: int) -> str:
    """Write the commonest longest strings (at most `most`) with their log10 probabilities and return the folder.

    A string that followed its context in the learning texts is coded there at once, so T and d of the context
    are all it takes; both are counted over all strings (a context has at most 256).
    """
    context = Window.partitionBy(F.shiftrightunsigned("key", 8))
    whole = F.sum("count").over(context) + F.count(F.lit(1)).over(context)
    least = least_count(strings, most)
    return write_table(
        strings.withColumn("whole", whole)
        .where(F.col("count") >= least)
        .select("key", (F.log10("count") - F.log10("whole")).alias("log")),
        "ppm-common",
    )


def resolve(strings: DataFrame, asked: DataFrame, order: int, low: str) -> DataFrame:
    """`key` and `log` (its log10 probability) of the distinct strings `asked`, by the counts of all strings.

    Both sides are dealt by the last bytes of the context, which all contexts of the orders from `split_order`
    on have in common: a task holds all that the trie knows there.
    """
    split = split_order(order)
    rows = strings.count() + asked.count()
    near = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * split) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, counts = (np.concatenate(c) for c in zip(*parts))
        del parts
        wanted = keys[counts == 0]
        if not len(wanted):
            return
        keys, counts = keys[counts > 0], counts[counts > 0]
        by = np.argsort(keys)
        levels = [(keys[by], counts[by])]
        for j in range(order - 1, split - 1, -1):
            suffix = levels[0][0] & np.uint64((1 << 8 * (j + 1)) - 1)
            short, at = np.unique(suffix, return_inverse=True)
            sums = np.zeros(len(short), np.int64)
            np.add.at(sums, at, levels[0][1])
            levels.insert(0, (short, sums))
        logs = Model(load_low(low, split) + levels).code(wanted)
        for s in range(0, len(wanted), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[s : s + 100_000].view(np.int64)), pa.array(logs[s : s + 100_000])],
                names=["key", "log"],
            )

    return (
        strings.select("key", "count")
        .unionByName(asked.select("key", F.lit(0).cast("bigint").alias("count")))
        .repartition(rows // _TASK_STRINGS + 1, near)
        .mapInArrow(run, "key bigint, log double")
    )


class Table:
    """Unsigned 64-bit keys to their row numbers, by open addressing; all look-ups at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.rows[slot] < 0
            winner, first = np.unique(slot[free], return_index=True)
            chosen = todo[free][first]
            self.rows[winner] = chosen
            self.keys[winner] = keys[chosen]
            lost = self.rows[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        slot = self._slot(keys)
        out = self.rows[slot]
        other = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[other]
        while len(other):
            slot = (slot + 1) & self.mask
            got = self.rows[slot]
            out[other] = got
            again = (got >= 0) & (self.keys[slot] != keys[other])
            other, slot = other[again], slot[again]
        return out


class Model:
    """The compiled trie."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[j]: sorted keys of j context bytes and a symbol, and their counts."""
        self.order = len(levels) - 1
        self.pairs, self.counts, self.contexts = [], [], []
        self.total, self.kinds, self.rest_total, self.rest_kinds = [], [], [], []
        for j, (keys, counts) in enumerate(levels):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            total = np.add.reduceat(counts, first) if len(keys) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(keys)))
            if j:
                mask = np.uint64((1 << 8 * j) - 1)
                low = levels[j - 1]
                ruled_out = low[1][np.searchsorted(low[0], keys & mask)]
                gone = np.zeros(len(first), np.int64)
                np.add.at(gone, owner, ruled_out)
                low_context = self.contexts_sorted
                at = np.searchsorted(low_context, (context[first] & np.uint64((1 << 8 * (j - 1)) - 1)))
                rest_total = self.total[j - 1][at] - gone
                rest_kinds = self.kinds[j - 1][at] - kinds
            else:
                rest_total = np.zeros(len(first), np.int64)
                rest_kinds = 256 - kinds
            self.pairs.append(Table(keys))
            self.counts.append(counts)
            self.contexts_sorted = context[first]
            self.contexts.append(Table(context[first]))
            self.total.append(total)
            self.kinds.append(kinds)
            self.rest_total.append(rest_total)
            self.rest_kinds.append(rest_kinds)
        top = levels[-1]
        if len(top[0]):
            whole = np.repeat(self.total[-1] + self.kinds[-1], self.kinds[-1])
            self.direct = np.log10(top[1]) - np.log10(whole)
        else:
            self.direct = np.zeros(0)

    def code(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        out = np.zeros(len(key))
        at = self.pairs[-1].find(key)
        known = at >= 0
        out[known] = self.direct[at[known]]
        todo = np.flatnonzero(~known)
        # Of each open symbol: whether a longer context has been left by an escape, and what T and d it left.
        entered = np.zeros(len(todo), dtype=bool)
        total, kinds = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        for j in range(self.order, -1, -1):
            k = key[todo] & np.uint64((1 << 8 * (j + 1)) - 1)
            context = self.contexts[j].find(k >> np.uint64(8))
            has = context >= 0
            fresh = has & ~entered
            total[fresh], kinds[fresh] = self.total[j][context[fresh]], self.kinds[j][context[fresh]]
            entered |= has
            pair = self.pairs[j].find(k) if j < self.order else np.full(len(todo), -1)
            found = pair >= 0
            whole = (total + kinds).astype(float)
            some = has & (whole > 0)
            hit = found & some
            out[todo[hit]] += np.log10(self.counts[j][pair[hit]]) - np.log10(whole[hit])
            miss = some & ~found & (kinds > 0)
            out[todo[miss]] += np.log10(kinds[miss]) - np.log10(whole[miss])
            total[has], kinds[has] = self.rest_total[j][context[has]], self.rest_kinds[j][context[has]]
            stay = ~hit
            todo, entered, total, kinds = todo[stay], entered[stay], total[stay], kinds[stay]
        left = np.where(entered, np.maximum(kinds, 1), 256)
        out[todo] -= np.log10(left)
        return out


@functools.lru_cache(maxsize=1)
def load_low(folder: str, split: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The orders below `split` of a folder, once per worker."""
    import pyarrow.parquet as pq

    system, root = arrow_filesystem(folder)
    t = pq.read_table(root, filesystem=system)
    j, key, count = t["j"].to_numpy(), t["key"].to_numpy().view(np.uint64), t["count"].to_numpy()
    levels = []
    for i in range(split):
        mine = j == i
        by = np.argsort(key[mine])
        levels.append((key[mine][by], count[mine][by]))
    return levels


@functools.lru_cache(maxsize=1)
def load_common(folder: str) -> tuple[Table, np.ndarray]:
    """The commonest strings of a folder and their log10 probabilities, once per worker."""
    import pyarrow.parquet as pq

    system, root = arrow_filesystem(folder)
    t = pq.read_table(root, filesystem=system)
    key, log = t["key"].to_numpy().view(np.uint64), t["log"].to_numpy()
    del t
    table = Table(key)
    pa.default_memory_pool().release_unused()
    return table, log


def folded(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of text and key, and how often each occurs."""
    by = np.lexsort((key, doc))
    doc, key = doc[by], key[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], key[first], np.diff(np.append(first, len(key)))


def held_out(id_col: str) -> Column:
    mod, rest = HELD_OUT
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(True))


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    max_nodes: int = MAX_NODES,
    common_words: int = COMMON_WORDS,
) -> DataFrame:
    """Every document: id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    spark = docs.sparkSession
    counts = materialise(count_all(docs.where(~held_out(id_col)), text, order), "ppm-counts")
    strings = counts.where(f"kind = {_GRAM}").select("key", "count")
    folder = common_strings(strings, max_nodes)
    words = counts.where(f"kind = {_WORD}").select("key", "count")
    n, v = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    least = least_count(words, common_words)
    common = words.where(F.col("count") >= least).toArrow()  # at most `common_words` rows
    key = common["key"].to_numpy().view(np.uint64)
    by = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[by], common["count"].to_numpy()[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals = shared.value
        table, log = load_common(folder)
        names = ["row", "id", "held_out", "n_tokens", "known", "logs", "score", "kind", "key", "times"]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in K.pieces(batch.column(2), _PIECE):
                w = K.Words(batch.column(2)[a:b], lower=True)
                g, cuts = grams(*canonical(w, order), order)
                place = table.find(g)
                unmet = np.flatnonzero(place < 0)
                logs_of = np.zeros(len(g))
                logs_of[place >= 0] = log[place[place >= 0]]
                coded = np.concatenate([[0.0], np.cumsum(logs_of)])
                h = np.concatenate([w.hashes(), np.full(b - a, _END)])
                doc = np.concatenate([w.doc_of_word(), np.arange(b - a)])
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                met = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                known = np.bincount(doc[met], minlength=b - a)
                logs = np.bincount(doc[met], np.log10(totals[at[met]] + 1.0), minlength=b - a)
                # Words and strings that aren't common: a row for each of them and text.
                wd, wk, wt = folded(doc[~met], h[~met])
                gd, gk, gt = folded(np.searchsorted(cuts, unmet, side="right") - 1, g[unmet])
                k, m = b - a, len(wk) + len(gk)
                null = lambda kind, c: pa.nulls(c, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row + np.arange(k), row + wd, row + gd])),
                        pa.concat_arrays([batch.column(0)[a:b], null(batch.column(0).type, m)]),
                        pa.concat_arrays([batch.column(1)[a:b], null(pa.bool_(), m)]),
                        pa.concat_arrays([pa.array(w.counts + 1), null(pa.int64(), m)]),
                        pa.concat_arrays([pa.array(known), null(pa.int64(), m)]),
                        pa.concat_arrays([pa.array(logs.astype(float)), null(pa.float64(), m)]),
                        pa.concat_arrays([pa.array(coded[cuts[1:]] - coded[cuts[:-1]]), null(pa.float64(), m)]),
                        pa.concat_arrays(
                            [null(pa.int8(), k), pa.array(np.repeat(np.array([_WORD, _GRAM], np.int8), [len(wk), len(gk)]))]
                        ),
                        pa.concat_arrays([null(pa.int64(), k), pa.array(np.concatenate([wk, gk]).view(np.int64))]),
                        pa.concat_arrays([null(pa.int64(), k), pa.array(np.concatenate([wt, gt]))]),
                    ],
                    names=names,
                )
                row += k

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text).alias("t")).mapInArrow(
        run,
        f"row bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, score double, "
        "kind tinyint, key bigint, times bigint",
    )
    scored = materialise(scored, "ppm-scored")
    rare = words.where(F.col("count") < least)
    late = (
        scored.where(f"kind = {_WORD}")
        .select("row", "key", "times")
        .join(rare, "key")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("more_logs"))
    )
    unmet = scored.where(f"kind = {_GRAM}").select("row", "key", "times")
    asked = materialise(unmet.select("key").distinct(), "ppm-asked")
    answers = materialise(resolve(strings, asked, order, low_orders(strings, order)), "ppm-answers")
    rest = unmet.join(answers, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    out = scored.where("kind IS NULL").drop("kind", "key", "times").join(late, "row", "left").join(rest, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (
            F.col("logs")
            + F.coalesce("more_logs", F.lit(0.0))
            - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
        ).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
