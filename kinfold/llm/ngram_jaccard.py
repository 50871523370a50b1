"""Exact Jaccard join of documents on their word n-grams.

The overlaps of all pairs are the product of the sparse document-by-gram matrix with its transpose. Only
blocks of it that can hold a link are computed:

* Rows: documents with the same set of grams are one row (a class).
* Columns, first block: with the grams of a row in one global order, two rows that reach the similarity
  share a gram among the first n - ceil(t n) + 1 of either ("prefix"). Rare grams come first in the order:
  the commonest grams (counted over all documents; at most `HINTS` of them) come last, by count. The order
  only decides how many pairs are looked at; any order gives the same links.
* Size bounds: a pair is dropped where the smaller set is too small for the larger one, or where the grams
  left behind the shared one cannot reach the overlap that the two sizes ask for.
* The overlaps of the first block are accumulated by pair; a pair goes where they and what is behind the
  prefixes cannot reach the bound.
* Remaining columns: for the pairs left, the overlap is accumulated over column blocks (ranges of gram
  hashes) and the pair is dropped as soon as what is left cannot reach the bound.

As the result is the components of the links, pairs inside a component already found need no product. First
every row of a gram is held against one of the rows that share it; these few pairs tie groups of near copies
together; then all remaining pairs of rows in different components are computed. Every link
between different components is therefore found, and a group of m near copies costs about m products.

Grams are 64-bit hashes. Defined results: texts without words (null, empty) have an empty set and link with
nothing; a text of fewer than `n` words is one gram, its whole sequence; repeated rows share a class;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialise, release, row_key
from .graph import components

N = 5
PERCENT = 80
#: Grams of at least HINT_COUNT texts are put last in the order, at most HINTS of them (12 bytes each).
HINTS, HINT_COUNT = 1 << 18, 24
#: A task reports grams that this many different sets of it share.
LOCAL_COUNT = 3
#: Texts hashed, and grams counted, at once by a task.
PIECE_BYTES, GRAMS_AT_ONCE = 512 << 10, 1_000_000
STAR_ROUNDS = 1
COLUMN_BLOCKS = 4
#: Keys of the texts to read again, or of copies to leave out, are broadcast up to this number (16 bytes each).
BROADCAST_KEYS = 2_000_000


def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text in ascending order, one after the other, and their offsets."""
    w = K.Words(texts, lower=True)
    prefix = K.Prefix(w.hashes())
    at, _ = K.windows(w.first, n)
    grams = prefix.hash(at, at + n)
    cuts = np.concatenate([[0], np.cumsum(np.maximum(w.counts - n + 1, 0))])
    out, sizes = [], np.zeros(w.docs, np.int64)
    for i in range(w.docs):
        if w.counts[i] >= n:
            g = np.sort(grams[cuts[i] : cuts[i + 1]])
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        elif w.counts[i]:
            g = prefix.hash(w.first[i : i + 1], w.first[i + 1 : i + 2])
        else:
            continue
        out.append(g)
        sizes[i] = len(g)
    return np.concatenate(out or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _set_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, from the sums of two mixes of its members and its size."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(grams), dtype=np.uint64)])
    b = np.concatenate(
        [[np.uint64(0)], np.cumsum(K.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)]
    )
    one, two = a[first[1:]] - a[first[:-1]], b[first[1:]] - b[first[:-1]]
    return K.mix(one ^ K.mix(two + np.diff(first).astype(np.uint64)))


def common_grams(docs: DataFrame, text: str, n: int) -> DataFrame:
    """`gram`, `count`: grams that several sets of a task share, summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays(
                [pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))],
                names=["gram", "count"],
            )

        for batch in batches:
            for a, b in K.pieces(batch.column(0), PIECE_BYTES):
                grams, first = gram_sets(batch.column(0)[a:b], n)
                for i, s in enumerate(_set_ids(grams, first).tolist()):
                    if s not in seen:
                        seen.add(s)
                        held.append(grams[first[i] : first[i + 1]])
                        total += len(held[-1])
                if total > GRAMS_AT_ONCE:
                    yield flush()
                    held, total, seen = [], 0, set()
        if held:
            yield flush()

    return (
        docs.select(text).mapInArrow(run, "gram bigint, count bigint")
        .groupBy("gram")
        .agg(F.sum("count").alias("count"))
        .where(F.col("count") >= HINT_COUNT)
    )


def _rows(docs: DataFrame, id_col: str, text: str, n: int, percent: int, hints) -> DataFrame:
    """A row per document: key, `n` (set size), `cls` (set id), `row` and the `prefix` of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weight = hints.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in K.pieces(batch.column(2), PIECE_BYTES):
                grams, first = gram_sets(batch.column(2)[a:b], n)
                sizes = np.diff(first)
                at = np.minimum(np.searchsorted(common, grams), max(len(common) - 1, 0))
                late = (
                    np.where(common[at] == grams, weight[at], 0)
                    if len(common)
                    else np.zeros(len(grams), np.int64)
                )
                any_late = K.per_doc(late > 0, first) > 0
                take = np.where(sizes > 0, sizes - _needed(sizes, percent) + 1, 0)
                parts = []
                for i in range(b - a):
                    g = grams[first[i] : first[i + 1]]
                    if any_late[i]:
                        g = g[np.lexsort((g, late[first[i] : first[i + 1]]))]
                    parts.append(g[: take[i]])
                flat = np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array(sizes),
                        pa.array(_set_ids(grams, first).view(np.int64)),
                        pa.array(np.arange(row, row + b - a)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    names=["__id", "__th", "n", "cls", "row", "prefix"],
                )
                row += b - a

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*row_key(id_col, text), text).mapInArrow(
        run, f"__id {kind}, __th bigint, n bigint, cls bigint, row bigint, prefix array<bigint>"
    )


def _overlap_reaches(percent: int):
    @F.arrow_udf("boolean")
    def reaches(x: pa.Array, y: pa.Array) -> pa.Array:
        xs, ys = (c.flatten().to_numpy().view(np.uint64) for c in (x, y))
        xo, yo = (np.asarray(c.offsets) - c.offsets[0].as_py() for c in (x, y))
        out = np.zeros(len(x), dtype=bool)
        edges = np.linspace(0, 2.0**64, COLUMN_BLOCKS + 1)[1:-1].astype(np.uint64)
        for i in range(len(x)):
            a, b = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            need = -(-percent * (len(a) + len(b)) // (100 + percent))
            ca = [0, *np.searchsorted(a, edges), len(a)]
            cb = [0, *np.searchsorted(b, edges), len(b)]
            got = 0
            for k in range(COLUMN_BLOCKS):
                got += len(np.intersect1d(a[ca[k] : ca[k + 1]], b[cb[k] : cb[k + 1]], assume_unique=True))
                if got + min(len(a) - ca[k + 1], len(b) - cb[k + 1]) < need:
                    break
            out[i] = 100 * got >= percent * (len(a) + len(b) - got)
        return pa.array(out)

    return reaches


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text: str, n: int, percent: int):
        self.docs, self.id_col, self.text, self.n, self.percent = docs, id_col, text, n, percent
        spark = docs.sparkSession
        top = common_grams(docs, text, n).orderBy(F.desc("count"), "gram").limit(HINTS).toArrow()
        gram = top["gram"].to_numpy().view(np.uint64)
        order = np.argsort(gram)
        hints = spark.sparkContext.broadcast((gram[order], top["count"].to_numpy()[order]))
        self.rows = materialise(_rows(docs, id_col, text, n, percent, hints), "gram-rows")
        # One row per class stands for it.
        self.classes = materialise(
            self.rows.where("n > 0")
            .groupBy("cls")
            .agg(
                F.min("__id").alias("least_id"),
                F.min(F.struct(F.col("__id").isNull(), "__id", "row", "__th", "n")).alias("first"),
            )
            .select("cls", "least_id", "first.row", "first.__id", "first.__th", "first.n"),
            "gram-classes",
        )

        repeats = self.rows.groupBy("__id", "__th").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        self.rows_repeat = not repeats.isEmpty()

    def shared(self) -> DataFrame:
        """The incidences of prefix grams that at least two classes have: `g`, `cls`, `n`, `pos`."""
        full = self.rows.where("n > 0").select("row")
        copies = full.join(self.classes.select("row"), "row", "left_anti")
        few = full.count() - self.classes.count() <= BROADCAST_KEYS
        stand = self.rows.join(F.broadcast(copies) if few else copies, "row", "left_anti")
        inc = stand.select("cls", "n", F.posexplode("prefix").alias("pos", "g")).select(
            "g", "cls", (F.shiftleft("n", 24) + F.col("pos")).alias("np")
        )
        many = inc.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
        met = inc.join(many, "g").select(
            "g",
            "cls",
            F.shiftright("np", 24).alias("n"),
            F.col("np").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("pos"),
        )
        out = materialise(met, "gram-incidence")
        release(self.docs.sparkSession)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (`a`, `b`) whose sets reach the similarity."""
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        need = self.classes.join(ends.distinct(), "cls", "left_semi").select("cls", "__id", "__th")
        side = F.broadcast(need) if 2 * pairs.count() <= BROADCAST_KEYS else need
        n = self.n

        @F.arrow_udf("array<bigint>")
        def sets(t: pa.Array) -> pa.Array:
            grams, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for a, b in K.pieces(t, PIECE_BYTES):
                g, f = gram_sets(t[a:b], n)
                first.append(f[1:] + first[-1][-1])
                grams.append(g)
            return pa.ListArray.from_arrays(
                pa.array(np.concatenate(first).astype(np.int32)),
                pa.array(np.concatenate(grams).view(np.int64)),
            )

        key = row_key(self.id_col, self.text)
        texts = self.docs.select(*key, F.col(self.text).alias("t"))
        same = texts["__id"].eqNullSafe(side["__id"]) & (texts["__th"] == side["__th"])
        found = texts.join(side, same).select("cls", sets("t").alias("grams"))
        found = materialise(found.dropDuplicates(["cls"]) if self.rows_repeat else found, "gram-sets")
        both = pairs.join(found.withColumnsRenamed({"cls": "a", "grams": "ga"}), "a").join(
            found.withColumnsRenamed({"cls": "b", "grams": "gb"}), "b"
        )
        out = materialise(both.where(_overlap_reaches(self.percent)("ga", "gb")).select("a", "b"), "gram-links")
        release(self.docs.sparkSession, found)
        return out

    def _possible(self, na, ia, nb, ib):
        """The size-derived bounds for two rows whose first shared gram is at `ia` and `ib`."""
        p = self.percent
        sizes = (100 * F.least(na, nb)) >= p * F.greatest(na, nb)
        room = 1 + F.least(na - ia, nb - ib) - 1
        return sizes & ((100 + p) * room >= p * (na + nb))

    def _promising(self, pairs: DataFrame, inc: DataFrame) -> DataFrame:
        """The pairs whose overlap in the first column block leaves the similarity possible.

        Of two prefixes, the one that ends earlier in the order shares nothing with the other row behind the
        other's prefix. So the overlap is at most the grams that the prefixes share and what one of the two
        rows has behind its prefix.
        """
        p = self.percent

        def behind(n):
            return F.ceil(n * F.lit(p) / F.lit(100)) - 1

        shared = (
            pairs.join(inc.select(F.col("cls").alias("a"), F.col("n").alias("na"), "g"), "a")
            .join(inc.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "g"), ["b", "g"])
            .groupBy("a", "b", "na", "nb")
            .agg(F.count(F.lit(1)).alias("c"))
        )
        most = F.col("c") + F.greatest(behind(F.col("na")), behind(F.col("nb")))
        return shared.where((100 + p) * most >= p * (F.col("na") + F.col("nb"))).select("a", "b")

    def components(self) -> DataFrame:
        """`cls`, `component` (a class) of the classes with links."""
        inc = self.shared()
        tested, links, labels = None, None, None
        for r in range(STAR_ROUNDS + 1):
            if labels is None:
                now = inc.withColumn("comp", F.col("cls"))
            else:
                now = inc.join(labels, "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
            now = now.select("g", "cls", "n", "pos", "comp")
            open_grams = (
                now.groupBy("g")
                .agg(
                    F.min("comp").alias("low"),
                    F.max("comp").alias("high"),
                    # The row with the fewest rarer grams: the original rather than an edited copy of it.
                    F.min(F.struct("pos", F.xxhash64("cls", F.lit(r)).alias("o"), "cls", "n", "comp")).alias("s"),
                )
                .where("low <> high")
            )
            if r < STAR_ROUNDS:
                met = now.join(open_grams.select("g", "s"), "g").where("comp <> s.comp")
                bound = self._possible(F.col("n"), F.col("pos"), F.col("s.n"), F.col("s.pos"))
                pairs = met.where(bound).select(F.col("cls").alias("x"), F.col("s.cls").alias("y"))
            else:
                left = now.join(open_grams.select("g"), "g", "left_semi")
                x, y = left.alias("x"), left.alias("y")
                bound = self._possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
                pairs = x.join(
                    y,
                    (F.col("x.g") == F.col("y.g"))
                    & (F.col("x.cls") < F.col("y.cls"))
                    & (F.col("x.comp") != F.col("y.comp"))
                    & bound,
                ).select(F.col("x.cls").alias("x"), F.col("y.cls").alias("y"))
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialise(pairs, "gram-pairs")
            release(self.docs.sparkSession)
            if pairs.isEmpty():
                continue
            tested = pairs if tested is None else tested.unionByName(pairs)
            promising = materialise(self._promising(pairs, inc), "gram-promising")
            release(self.docs.sparkSession)
            new = self.links(promising)
            links = new if links is None else links.unionByName(new)
            labels = components(links).select(F.col("node").alias("cls"), "component")
        if labels is None:
            return self.classes.select("cls", F.col("cls").alias("component")).limit(0)
        return labels


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT
) -> DataFrame:
    """Every document: id, text hash `__th`, `n_shingles`, `component_id` (the smallest id reachable by
    links) and `first` (whether it is the one document that stands for its component)."""
    return _labelled(_Join(docs, id_col, text, n, percent))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT
) -> DataFrame:
    """One document of each component (the one with the smallest id), with the columns they came with;
    documents without words all stay."""
    join = _Join(docs, id_col, text, n, percent)
    found = _labelled(join)
    gone = found.where(~F.col("first")).select(F.col(id_col).alias("__id"), "__th")
    if join.rows_repeat:
        # Copies of a row share its key: drop the key only where no row of it stays, then keep one of them.
        stay = found.where("first").select(F.col(id_col).alias("__id"), "__th")
        same = gone["__id"].eqNullSafe(stay["__id"]) & (gone["__th"] == stay["__th"])
        gone = gone.join(stay, same, "left_anti")
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    kept = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (th == gone["__th"]), "left_anti")
    if join.rows_repeat:
        has_word = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(has_word).dropDuplicates([id_col, text]).unionByName(kept.where(~has_word))
    return kept


def _labelled(join: _Join) -> DataFrame:
    id_col, labels = join.id_col, join.components()
    of_class = join.classes.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(
        F.min("least_id").alias("component_id"), F.min(F.struct(F.col("least_id").isNull(), "least_id", "row")).alias("f")
    )
    of_class = materialise(
        of_class.join(least, "component").select("cls", "component_id", F.col("f.row").alias("f_row")),
        "gram-components",
    )
    out = join.rows.select("__id", "__th", "n", "cls", "row").join(of_class, "cls", "left")
    return out.select(
        F.col("__id").alias(id_col),
        "__th",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("f_row"), F.lit(True)).alias("first"),
    )
