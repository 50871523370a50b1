"""Near copies by bottom-k sketches: one hash function, inverted lists, union-sketch estimates, exact Jaccard.

A document's set is its distinct `n`-word shingles, hashed once. Its sketch is the `k` smallest hashes.

* Documents with the same set are one class (128-bit set id); classes alone are compared.
* Inverted lists: two classes whose similarity is at least the threshold share, but for a chance given below,
  at least `least * s` of the s values of either sketch, so in any one order of the values they share one of
  the first s - least * s + 1. The commonest values come last in that order, and each class is listed under
  its first values only. Sets of at most threshold * k shingles are known whole with any partner of theirs:
  they are listed under their first n - threshold * n + 1 values, and nothing can be lost.
* Sizes: a pair goes where the smaller set is too small for the larger one.
* Places: the first value that two linked sets share, in the common order, stands before all others they share, so
  enough must be left of both behind it. A class that no other of a list can meet in this way leaves the list.
* Signature: the parities of counts, one for each remainder of the sketch's hashes: 512, or 1,024 for sets of more than
  384 shingles. Two sketches differ in at least as many values as bits. The threshold allows sets known whole to differ
  in (1 - t) / (1 + t) of both sizes, and other sketches in all but 2 * least * k values of the two; pairs beyond that
  never leave the list, so a list of m unlike classes gives few rows rather than m squared. Nothing is lost by it that
  the union sketch would not drop. Sets of more than 512 shingles have a wide signature of the whole set as well,
  which the pairs found are held against.
* Union sketch: the k smallest values of two sketches together are the sketch of the union. The share of them
  that both hold estimates the similarity; pairs below `least` go. A union of fewer than k is known whole, and
  pairs of it go below the threshold itself.
* Exact: the full sets of the pairs left are intersected. Pairs travel with their texts, which take less room than
  their sets; sketches and sets are made again from them.

For sets above threshold * k the estimate is a draw of k values without replacement, of which at least 80 % are
shared in truth. With k = 512 and least = 0.67 the chance that a linked pair falls below is at most
exp(-512 KL(0.67 || 0.8)) = 5e-11 by Chernoff's bound, at similarity 0.8 and less above it.

The result is components, so pairs inside a component need no test. First each class is held against one of
each list (the one with the fewest rarer values: an original rather than its edited copy). Then, list by list, the
classes outside the list's largest component meet all others of another component. A list of m near copies costs
m pairs in this way, and nothing is drawn, capped or dropped.

Defined results: texts without words (null, empty) have an empty set and link with nothing; a text of fewer
than `n` words is one shingle; a row without id takes part (its component is the smallest id reached; null if
there is none); repeated rows are one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialise, release, row_key
from .graph import components

N, PERCENT = 2, 80
SKETCH, LEAST_PERCENT = 512, 67
PIECE_BYTES = 512 << 10
#: Values that at least COMMON_COUNT classes of one task's share retain come last in the order; the COMMON
#: commonest of them (16 bytes each) are sent to the tasks. The order decides what is looked at, not what is found.
COMMON, COMMON_COUNT, COUNT_AT_ONCE = 1 << 18, 3, 1_000_000
#: The bitmap of the texts that pairs need has this many bits a text (so about 1 in 16 of the others is moved too),
#: and at most 2**MAX_BITS (16 MB in the tasks).
BITS_A_TEXT, MAX_BITS = 16, 26
#: Classes and lists are made in so many passes, each of which shuffles a part of the keys: less disk is held at once.
PASSES = 2
#: Sets of more shingles than this have a wide signature too.
WIDE = 512
SIGNATURE_LONGS = 8
#: Sets of more shingles than this have a signature of twice the length.
NARROW = 384
SIGNATURE = [f"s{i}" for i in range(2 * SIGNATURE_LONGS)]


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and their offsets."""
    w = K.Words(texts, lower=True)
    prefix = K.Prefix(w.hashes())
    at, doc = K.windows(w.first, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    values = np.concatenate([prefix.hash(at, at + n), prefix.hash(w.first[short], w.first[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(w.docs + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return upto[first[1:]] - upto[first[:-1]]


def _signatures(values: np.ndarray, first: np.ndarray, longs: int = SIGNATURE_LONGS) -> np.ndarray:
    """A row of `longs` longs per text: how often, modulo 2, its hashes fall on each bit."""
    size = np.diff(first)
    out = np.zeros((len(size), longs), dtype=np.uint64)
    at = K.mix(values) % np.uint64(64 * longs)
    long = (at >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(size)), size), long), np.uint64(1) << (at & np.uint64(63)))
    return out


def _sketch_signatures(kept: np.ndarray, cuts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signatures of the sketches of sets of so many shingles; half of a narrow one's row is zero."""
    out = _signatures(kept, cuts, 2 * SIGNATURE_LONGS)
    narrow = size <= NARROW
    out[narrow, :SIGNATURE_LONGS] ^= out[narrow, SIGNATURE_LONGS:]
    out[narrow, SIGNATURE_LONGS:] = 0
    return out


def _wide(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and longs of a signature of two to four bits a shingle, for the sets of more than `WIDE` shingles."""
    size = np.diff(first)
    big = size > WIDE
    bits = np.where(big, 1 << np.ceil(np.log2(2 * np.maximum(size, 1))).astype(np.int64), 0)
    offsets = np.concatenate([[0], np.cumsum(bits >> 6)])
    out = np.zeros(offsets[-1], dtype=np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    doc, values = doc[big[doc]], values[big[doc]]
    at = K.mix(values) & (bits[doc] - 1).astype(np.uint64)
    np.bitwise_xor.at(out, offsets[doc] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return offsets, out


def _wide_possible(percent: int):
    @F.arrow_udf("boolean")
    def possible(n: pa.Array, x: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
        """The bound by wide signatures. Folding one in half gives the signature of half the bits."""
        (xs, xo), (ys, yo) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (x, y))
        bits = np.zeros(len(x), dtype=np.int64)
        for i in range(len(x)):
            a, b = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            while len(a) > len(b):
                a = a[: len(a) // 2] ^ a[len(a) // 2 :]
            while len(b) > len(a):
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            bits[i] = np.bitwise_count((a ^ b).view(np.uint64)).sum()
        return pa.array((100 + percent) * bits <= (100 - percent) * (n.to_numpy() + m.to_numpy()))

    return possible


def _firsts(first: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Places of the first `take` entries of each stretch."""
    ends = np.cumsum(take)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[:-1] - (ends - take), take)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(texts: pa.Array, n: int, k: int) -> tuple:
    """Shingles of each text, their offsets, and the places and offsets of the sketches among them."""
    values, first = shingles(texts, n)
    take = np.minimum(np.diff(first), k)
    return values, first, _firsts(first, take), np.concatenate([[0], np.cumsum(take)])


def _rows(docs: DataFrame, id_col: str, text: str, n: int, k: int, percent: int, least: int) -> DataFrame:
    """A row per document: key, `n` (set size), `h1`, `h2` (set id), `row`, signature and `listed`: the values
    of the sketch that it is listed under, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, text, n, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weight = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in K.pieces(batch.column(2), PIECE_BYTES):
                values, first, places, cuts = _sketch(batch.column(2)[a:b], n, k)
                size = np.diff(first)
                one = _sums(K.mix(values), first) + size.astype(np.uint64)
                two = _sums(K.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                kept = values[places]
                signature = _sketch_signatures(kept, cuts, size).view(np.int64)
                late = np.zeros(len(kept), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, kept), len(common) - 1)
                    late = np.where(common[at] == kept, weight[at], 0)
                order = np.lexsort((kept, late, np.repeat(np.arange(b - a), np.diff(cuts))))
                take = np.where(size > 0, _listed(size, k, percent, least), 0)
                listed = kept[order][_firsts(cuts, take)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array(size),
                        pa.array(K.mix(one).view(np.int64)),
                        pa.array(K.mix(two).view(np.int64)),
                        pa.array(np.arange(row, row + b - a)),
                        _lists(np.concatenate([[0], np.cumsum(take)]), listed),
                        _lists(*_wide(values, first)),
                        *[pa.array(np.ascontiguousarray(c)) for c in signature.T],
                    ],
                    names=["__id", "__th", "n", "h1", "h2", "row", "listed", "wide", *SIGNATURE],
                )
                row += b - a

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*row_key(id_col, text), text).mapInArrow(
        run,
        f"__id {kind}, __th bigint, n bigint, h1 bigint, h2 bigint, row bigint, listed array<bigint>, wide array<bigint>, "
        + ", ".join(f"{c} bigint" for c in SIGNATURE),
    )


def _common(docs: DataFrame, text: str, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest retained values, ascending, and in how many sketches they were counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= COMMON_COUNT
            return pa.RecordBatch.from_arrays(
                [pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["g", "count"]
            )

        for batch in batches:
            for a, b in K.pieces(batch.column(0), PIECE_BYTES):
                values, _, places, _ = _sketch(batch.column(0)[a:b], n, k)
                held.append(values[places])
                total += len(held[-1])
                if total >= COUNT_AT_ONCE:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    top = (
        docs.select(text)
        .mapInArrow(run, "g bigint, count bigint")
        .groupBy("g")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "g")
        .limit(COMMON)
        .toArrow()
    )
    g, count = top["g"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(g)
    return g[order], count[order]


def _listed(n, k: int, percent: int, least: int):
    """How many values of a sketch, in the common order, a class is listed under (array or number)."""
    size = np.minimum(n, k)
    whole = 100 * n <= percent * k
    share = np.where(whole, percent, least)
    return size - -(-size * share // 100) + 1


def _estimate(k: int, percent: int, least: int):
    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        """Whether both sketches hold enough of the k smallest values of their union."""
        parts = []
        for side in (x, y):
            parts.append((side.flatten().to_numpy(), np.repeat(np.arange(len(side)), np.diff(side.offsets.to_numpy()))))
        values = np.concatenate([p[0] for p in parts]).view(np.uint64)
        pair = np.concatenate([p[1] for p in parts])
        order = np.lexsort((values, pair))
        values, pair = values[order], pair[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (pair[1:] != pair[:-1])
        both = np.zeros(len(values), dtype=bool)
        both[:-1] = ~new[1:]
        both, pair = both[new], pair[new]
        begin = np.searchsorted(pair, np.arange(len(x) + 1))
        rank = np.arange(len(pair)) - begin[pair]
        kept = rank < k
        shared = np.bincount(pair[kept & both], minlength=len(x))
        total = np.bincount(pair[kept], minlength=len(x))
        return pa.array(100 * shared >= np.where(total < k, percent, least) * total)

    return near


def _similar(k: int, percent: int, least: int, n: int):
    near = _estimate(k, percent, least).func

    @F.arrow_udf("boolean")
    def reaches(x: pa.Array, y: pa.Array) -> pa.Array:
        """Whether the sets of two texts reach the threshold, of those pairs that the union sketch lets through."""
        out = np.zeros(len(x), dtype=bool)
        for a, b in K.pieces(x, PIECE_BYTES):
            for c, d in K.pieces(y[a:b], PIECE_BYTES):
                out[a + c : a + d] = _reach(x[a + c : a + d], y[a + c : a + d], n, k, percent, near)
        return pa.array(out)

    return reaches


def _reach(x: pa.Array, y: pa.Array, n: int, k: int, percent: int, near) -> np.ndarray:
    sides, heads = [], []
    for texts in (x, y):
        # A text that is in many pairs is cut once.
        texts = texts.dictionary_encode()
        values, first, places, cuts = _sketch(texts.dictionary, n, k)
        at = texts.indices.to_numpy()
        sides.append((values, first[at], first[at + 1]))
        heads.append(_lists(cuts, values[places]).take(texts.indices))
    out = near(*heads).to_numpy(zero_copy_only=False).copy()
    (xs, x0, x1), (ys, y0, y1) = sides
    for i in np.flatnonzero(out):
        a, b = xs[x0[i] : x1[i]], ys[y0[i] : y1[i]]
        both = len(np.intersect1d(a, b, assume_unique=True))
        out[i] = 100 * both >= percent * (len(a) + len(b) - both)
    return out


def _folded(prefix: str = "") -> list:
    """The signature in `SIGNATURE_LONGS` columns, whatever the set's size."""
    half = SIGNATURE_LONGS
    return [F.col(prefix + a).bitwiseXOR(F.col(prefix + b)) for a, b in zip(SIGNATURE[:half], SIGNATURE[half:], strict=True)]


class _Search:
    def __init__(self, docs: DataFrame, id_col: str, text: str, n: int, percent: int, k: int, least: int):
        if not 0 < least <= percent <= 100:
            raise ValueError("the least share of the estimate must be above 0 and at most the threshold")
        self.docs, self.id_col, self.text = docs, id_col, text
        self.n, self.percent, self.k, self.least = n, percent, k, least
        spark = docs.sparkSession
        rows = materialise(_rows(docs, id_col, text, n, k, percent, least), "sketch-wide-rows")
        # One row stands for each class; all of them are listed alike.
        parts = self._passes(
            rows.where("n > 0"),
            "h1",
            lambda part: part.groupBy("h1", "h2")
            .agg(
                F.min("__id").alias("least_id"),
                F.min(F.struct(F.col("__id").isNull(), "__id", "row", "__th", "n")).alias("f"),
                *[F.any_value(c).alias(c) for c in ("listed", "wide", *SIGNATURE)],
            )
            .select("h1", "h2", "least_id", F.col("f.row").alias("cls"), "f.__id", "f.__th", "f.n", "listed", "wide", *SIGNATURE),
            "sketch-wide-classes",
        )
        # The listed values are read once more, for the lists; what is kept to the end goes without them.
        self.rows = materialise(rows.select("__id", "n", "h1", "h2"), "sketch-rows")
        release(spark, rows)
        classes = reduce(DataFrame.unionByName, parts)
        self.lists = self._lists(classes)
        self.classes = materialise(classes.drop("listed"), "sketch-classes")
        release(spark, *parts)

    def _passes(self, table: DataFrame, key: str, made, label: str) -> list[DataFrame]:
        """`made` of the rows of each part of the keys, written one after the other."""
        out = []
        for i in range(PASSES):
            out.append(materialise(made(table.where(F.pmod(F.col(key), F.lit(PASSES)) == i)), label))
            release(self.docs.sparkSession)
        return out

    def _lists(self, classes: DataFrame) -> list[DataFrame]:
        """The incidences at which a class can meet another one, with one class (`y`, its size `m` and place `q`) of
        what is left of each list: the one with the fewest rarer values."""
        p = self.percent
        inc = classes.select("cls", "n", F.posexplode("listed").alias("pos", "g"))
        # `p` times the size of the largest set that this one can meet there. The places bound sets known whole.
        whole = 100 * F.col("n") <= p * self.k
        reach = F.when(whole, (100 + p) * (F.col("n") - F.col("pos")) - p * F.col("n")).otherwise(100 * F.col("n"))
        inc = inc.withColumn("reach", reach)

        def met(inc: DataFrame) -> DataFrame:
            # Of two classes that can meet, the smaller one reaches the larger one.
            by_size = Window.partitionBy("g").orderBy("n")
            larger = p * F.lead("n").over(by_size) <= F.col("reach")
            smaller = F.max("reach").over(by_size.rowsBetween(Window.unboundedPreceding, -1)) >= p * F.col("n")
            inc = inc.withColumn("larger", larger).withColumn("smaller", smaller).where("larger or smaller")
            star = F.min(F.struct("pos", F.xxhash64("cls").alias("o"), "cls", "n")).over(Window.partitionBy("g"))
            inc = inc.select("g", "cls", "n", "pos", star.alias("s"))
            return inc.select("g", "cls", "n", "pos", F.col("s.cls").alias("y"), F.col("s.n").alias("m"), F.col("s.pos").alias("q"))

        return self._passes(inc, "g", met, "sketch-lists")

    def _texts(self, need: DataFrame) -> DataFrame:
        """`cls` and the text `t` of each class of `need`.

        A bitmap of the needed text hashes keeps most other texts from being moved.
        """
        bits = 1 << min(MAX_BITS, max(10, (BITS_A_TEXT * need.count()).bit_length()))
        bit = F.pmod(F.col("__th"), F.lit(bits))
        held = (
            need.select(F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        )
        texts = self.docs.select(*row_key(self.id_col, self.text), F.col(self.text).alias("t"))
        texts = texts.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(held), "word")
        texts = texts.where(F.getbit("mask", (bit % 64).cast("int")) == 1)
        # Rows that agree in id and text hash are copies, and any of them serves.
        key = [F.col("__id").isNull().alias("k0"), F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("k1")]
        key.append(F.col("__th").alias("k2"))
        once = texts.select(*key, "t").dropDuplicates(["k0", "k1", "k2"])
        return once.join(need.select("cls", *key), ["k0", "k1", "k2"]).select("cls", "t")

    def _like(self, pairs: DataFrame) -> DataFrame:
        """The pairs that wide signatures, where both classes have one, leave possible."""
        wide = self.classes.where(F.size("wide") > 0).select("cls", "n", "wide")
        for end in ("a", "b"):
            pairs = pairs.join(wide.withColumnsRenamed({"cls": end, "n": f"{end}_n", "wide": f"{end}_wide"}), end, "left")
        both = F.col("a_n").isNotNull() & F.col("b_n").isNotNull()
        # The rest have no signature to compare: an empty one differs in no bit.
        sides = [F.when(both, F.col(c)).otherwise(none) for c, none in (
            ("a_n", F.lit(0)), ("a_wide", F.array().cast("array<bigint>")), ("b_n", F.lit(0)), ("b_wide", F.array().cast("array<bigint>"))
        )]
        out = materialise(pairs.where(_wide_possible(self.percent)(*sides)).select("a", "b"), "sketch-like")
        release(self.docs.sparkSession)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (`a`, `b`) that the union sketch and then the full sets confirm."""
        pairs = self._like(pairs)
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        spark = self.docs.sparkSession
        need = materialise(self.classes.join(ends, "cls", "left_semi").select("cls", "__id", "__th"), "sketch-ends")
        found = materialise(self._texts(need), "sketch-texts")
        release(spark, need)
        # Both are tables, so a class of many pairs can be split.
        met = pairs.join(found.withColumnsRenamed({"cls": "a", "t": "ta"}), "a")
        met = met.join(found.withColumnsRenamed({"cls": "b", "t": "tb"}), "b")
        confirmed = _similar(self.k, self.percent, self.least, self.n)("ta", "tb")
        out = materialise(met.where(confirmed).select("a", "b"), "sketch-links")
        release(spark, found, pairs)
        return out

    def _sizes(self, n, m):
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def _meets(self, n, i, m, j):
        """The bounds by sizes and, where both sets are known whole, by the places of the list's value in them."""
        p = self.percent
        left = (100 + p) * F.least(n - i, m - j) >= p * (n + m)
        return self._sizes(n, m) & ((F.greatest(n, m) > self.k) | left)

    def _possible(self, n, m, s, t):
        """The bounds by set sizes and by signatures `s`, `t` for two classes of one list."""
        p = self.percent
        differ = reduce(add, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(s, t, strict=True)])
        # A union of more than k values must share `least` of its first k; both sketches hold those.
        shared = -(-self.least * self.k // 100)
        held = F.least(n, F.lit(self.k)) + F.least(m, F.lit(self.k)) - 2 * shared
        near = F.when(F.greatest(n, m) > self.k, differ <= held).otherwise((100 + p) * differ <= (100 - p) * (n + m))
        return self._sizes(n, m) & near

    def _stars(self, now: DataFrame) -> DataFrame:
        """Each class with one class of each list it is in."""
        met = now.where("cls <> y").where(self._meets(F.col("n"), F.col("pos"), F.col("m"), F.col("q")))
        pairs = self._distinct(met.select(F.col("cls").alias("x"), "y"))
        signed = self.classes.select("cls", "n", *SIGNATURE)
        for end in ("a", "b"):
            pairs = pairs.join(signed.withColumnsRenamed({c: f"{end}_{c}" for c in ("n", *SIGNATURE)}).withColumnRenamed("cls", end), end)
        n, m = F.col("a_n"), F.col("b_n")
        wide = self._possible(n, m, *([F.col(f"{end}_{c}") for c in SIGNATURE] for end in ("a", "b")))
        narrow = self._possible(n, m, *(_folded(f"{end}_") for end in ("a", "b")))
        pairs = pairs.where(F.when(F.least(n, m) > NARROW, wide).otherwise(narrow))
        out = materialise(pairs.select("a", "b"), "sketch-pairs")
        release(self.docs.sparkSession)
        return out

    def _others(self, now: DataFrame) -> DataFrame:
        """List by list, the classes outside the largest component with all of another component."""
        sizes = now.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"))
        open_ = materialise(
            sizes.groupBy("g")
            .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "comp")).alias("top"))
            .where("parts > 1")
            .select("g", F.col("top.comp").alias("big")),
            "sketch-open",
        )
        left = now.join(open_, "g").withColumn("top", F.col("comp") == F.col("big")).drop("big")
        left = materialise(left.join(self.classes.select("cls", *SIGNATURE), "cls"), "sketch-open-lists")
        release(self.docs.sparkSession, now, open_)
        # Pairs with a narrow set, by signatures of one length, and pairs of others.
        few = SIGNATURE[:SIGNATURE_LONGS]
        columns = [F.col(c) for c in ("g", "cls", "n", "pos", "comp", "top")]
        narrow = left.where(self.percent * F.col("n") <= 100 * NARROW)
        narrow = narrow.select(*columns, *[s.alias(c) for s, c in zip(_folded(), few, strict=True)])
        found = self._met(narrow, few, F.least(F.col("x.n"), F.col("y.n")) <= NARROW)
        found = found.unionByName(self._met(left.where(F.col("n") > NARROW).select(*columns, *SIGNATURE), SIGNATURE))
        pairs = self._distinct(found)
        release(self.docs.sparkSession, left)
        return pairs

    def _met(self, left: DataFrame, signature: list[str], which=None) -> DataFrame:
        """The pairs (`x`, `y`) of `left` that can be linked, once for each list."""
        outside, top = left.where("not top").drop("top"), left.where("top").drop("top")
        # Three of the four sides are the same rows under the same conditions, so each row is shuffled once.
        apart = (F.col("x.g") == F.col("y.g")) & (F.col("x.comp") != F.col("y.comp"))
        found = []
        for others, once in ((top, F.col("x.cls") != F.col("y.cls")), (outside, F.col("x.cls") < F.col("y.cls"))):
            met = outside.alias("x").join(others.alias("y"), apart & once)
            if which is not None:
                met = met.where(which)
            met = met.where(self._meets(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
            sides = [F.col(f"x.{c}") for c in signature], [F.col(f"y.{c}") for c in signature]
            met = met.where(self._possible(F.col("x.n"), F.col("y.n"), *sides))
            found.append(met.select(F.col("x.cls").alias("x"), F.col("y.cls").alias("y")))
        return found[0].unionByName(found[1])

    def components(self) -> DataFrame:
        """`cls`, `component` (a class) of the classes with links."""
        inc = reduce(DataFrame.unionByName, self.lists)
        pairs = self._stars(inc)
        links = self.linked(pairs)
        labels = components(links).select(F.col("node").alias("cls"), "component")
        # What meets the class that stands for a list has been seen.
        now = inc.where("cls <> y").select("g", "cls", "n", "pos").join(labels, "cls", "left")
        now = now.withColumn("comp", F.coalesce("component", "cls")).drop("component")
        now = materialise(now, "sketch-now")
        release(self.docs.sparkSession, *self.lists)
        rest = self._others(now)
        rest = materialise(rest.join(pairs, ["a", "b"], "left_anti"), "sketch-pairs")
        if rest.isEmpty():
            return labels
        links = links.unionByName(self.linked(rest))
        return components(links).select(F.col("node").alias("cls"), "component")

    def _distinct(self, pairs: DataFrame) -> DataFrame:
        return materialise(
            pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "sketch-pairs"
        )


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    n: int = N,
    percent: int = PERCENT,
    k: int = SKETCH,
    least: int = LEAST_PERCENT,
) -> DataFrame:
    """Every document: id, `n_shingles`, `component_id` (the smallest id reachable by links) and `kept`
    (whether it is that document)."""
    search = _Search(docs, id_col, text, n, percent, k, least)
    labels = search.components()
    of_class = search.classes.select("h1", "h2", "cls", "least_id").join(labels, "cls", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "cls"))
    least_id = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = materialise(
        of_class.join(least_id, "component").select("h1", "h2", "component_id"), "sketch-components"
    )
    out = search.rows.select("__id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id"))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("__id").eqNullSafe(component).alias("kept"),
    )
