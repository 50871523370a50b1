"""What each filter of a chain removes, for every order of the filters.

Every document gets a mask, one bit for each filter that it fails; only the counts of each (part, mask) are
kept. A walk through the subsets of filters in Gray-code order switches one filter on or off at a time: each
mask cell counts how many of its failing filters are on, and its documents leave the survivors as that
counter leaves 0 and come back as it returns there. The survivors of all subsets (32 for five filters) are
stored; what a filter removes at any place of any order is the difference of two of them.

The filter on repeated texts looks at the whole table: a text fails where a smaller id has the same text. All
copies of a text share the other bits, so the copies are counted by text (map-side first: a text that a third of
the rows share is a few rows per task by then) and the rows with the smallest id are taken off; no row is joined
back. Texts are compared by SHA-256.

Defined results: null text counts as empty; a null part as the empty string; rows without id have no labels
and are no copies of anything; repeated rows with one id count one by one, and none is a copy of the other;
labels given twice for an id hold where one of them does. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

SPACES = r"[\x20\x09-\x0D]+"
#: Fewer words than this; distinct words and capitals in percent.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
#: The name of the filter on repeated texts; it comes behind the filters on single texts.
COPIES = "E"


def text_filters(text: Column) -> Column:
    """The failures of filters A to D as bits 0 to 3."""
    t = F.coalesce(text, F.lit(""))

    def lengths(words: Column) -> Column:
        n = F.size(words)
        few = (n < MIN_WORDS).cast("int")
        alike = (100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n).cast("int")
        return few + 2 * alike

    words = F.array_remove(F.split(t, SPACES, -1), "")
    capitals = 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * F.length(t)
    return let(words, lengths) + 4 * capitals.cast("int") + 8 * t.rlike("[#$%&*|]").cast("int")


def cells(
    docs: DataFrame, labels: DataFrame, mask: Column, copies_bit: int, id_col: str, text: str, part: str
) -> DataFrame:
    """`part`, `mask`, `n`, `good`, `toxic`: documents of each mask, the bit of repeated texts included."""
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("h"),
    )
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    )
    # The join has dealt the rows by id, so this grouping needs no exchange of its own.
    rows = (
        narrow.where("id is not null")
        .join(marks, "id", "left")
        .groupBy("id", "h", "part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    by_text = rows.groupBy("h", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")],
        F.min(F.struct("id", "n", "good", "toxic")).alias("first"),
    )
    # At most a row per part and text is left here, so the window's groups are as small as the list of parts.
    least = F.min("first.id").over(Window.partitionBy("h"))
    split = by_text.withColumn("original", F.col("first.id") == least)
    sums = []
    for c in ("n", "good", "toxic"):
        original = F.when(F.col("original"), F.col(f"first.{c}")).otherwise(0)
        sums += [F.sum(original).alias(f"{c}_0"), F.sum(F.col(c) - original).alias(f"{c}_1")]
    both = split.groupBy("part", "mask").agg(*sums)
    out = both.select(
        "part",
        F.explode(
            F.array(
                *[
                    F.struct(
                        (F.col("mask") + (i << copies_bit)).alias("mask"),
                        *[F.col(f"{c}_{i}").alias(c) for c in ("n", "good", "toxic")],
                    )
                    for i in (0, 1)
                ]
            )
        ).alias("c"),
    ).select("part", "c.*")
    unnamed = narrow.where("id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    return (
        out.unionByName(unnamed.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")))
        .groupBy("part", "mask")
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    )


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: `counts` and the result are (parts, 2**k, kinds)."""
    size = counts.shape[1]
    masks = np.arange(size)
    failing = np.zeros(size, dtype=np.int64)  # filters on now that the mask fails
    survivors = counts.sum(axis=1)
    states = np.zeros_like(counts)
    states[:, 0] = survivors
    on = 0
    for step in range(1, size):
        bit = step & -step
        on ^= bit
        hit = (masks & bit) > 0
        if on & bit:
            survivors = survivors - counts[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            survivors = survivors + counts[:, hit & (failing == 0)].sum(axis=1)
        states[:, on] = survivors
    return states


FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _steps(letters: str):
    """(order, step, filters before as a mask, bit) of every place of every order."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    for order in permutations(letters):
        before = 0
        for step, c in enumerate(order, 1):
            yield "".join(order), step, before, bit[c]
            before |= bit[c]


def audit_cells(found: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step from the counts of the (part, mask) cells."""
    k = len(letters)
    steps = list(_steps(letters))
    order, step, before, bit = (np.array(c) for c in zip(*steps, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("cells")
            entry = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            counts = np.zeros((len(lists), 1 << k, 3), dtype=np.int64)
            at = entry.field("mask").to_numpy(zero_copy_only=False)
            for i, c in enumerate(("n", "good", "toxic")):
                counts[owner, at, i] = entry.field(c).to_numpy(zero_copy_only=False)
            states = gray_walk(counts)
            drop = states[:, before] - states[:, before | bit]  # parts, steps, kinds
            fails = {1 << i: counts[:, (np.arange(1 << k) >> i) & 1 == 1, 0].sum(axis=1) for i in range(k)}
            total, alone, worth = (np.zeros(drop.shape[:2], dtype=np.int64) for _ in range(3))
            for f in fails:
                mine = bit == f
                total[:, mine] = fails[f][:, None]
                full = (1 << k) - 1
                alone[:, mine] = (states[:, full ^ f, 0] - states[:, full, 0])[:, None]
                without = [s for s in range(1 << k) if not s & f]
                weight = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in without]
                gone = states[:, without, 0] - states[:, [s | f for s in without], 0]
                worth[:, mine] = (gone * np.array(weight)).sum(axis=1)[:, None]
            values = [
                states[:, before | bit, 0],
                drop[:, :, 0],
                total - drop[:, :, 0],
                alone,
                drop[:, :, 1],
                drop[:, :, 2],
                worth,
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("part").take(pa.array(np.repeat(np.arange(len(lists)), len(steps)))),
                    pa.array(np.tile(order, len(lists)).tolist(), pa.string()),
                    pa.array(np.tile(step, len(lists)), pa.int32()),
                    *[pa.array(v.ravel()) for v in values],
                ],
                names=["part", "filter_order", "step", *FIELDS],
            )

    grouped = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in FIELDS)
    return grouped.mapInArrow(run, schema)


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """One row per part, order of the filters A to E and step, with what the step's filter does there.

    `kept` after the step, `removed` at it, `redundant` (failing it, removed before), `unique_fails` (failing
    nothing else), `good_lost` and `toxic_lost` (of the removed), `shapley` (removed, summed over all orders).
    """
    mask = text_filters(F.col(text))
    found = cells(docs, labels, mask, 4, id_col, text, part)
    return audit_cells(found, "ABCD" + COPIES)
