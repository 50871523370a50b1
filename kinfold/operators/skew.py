"""Joins in which a few keys hold much of one side.

Hot keys are found by a mergeable frequency sketch of the large side (one scan, a bounded number of counters per
task, merged). Every key above `share` of the rows is found; a key taken for hot by an over-count costs a few copied
rows and changes nothing. Rows of hot keys are dealt over as many salts as their share asks for, and only those
keys of the other side are copied, once for each salt. All other rows join as they would have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import small_side

#: A key with more than this share of the rows is split.
SHARE = 0.02
MAX_SALTS = 256
#: Counters of the sketch; its error is at most a few n / COUNTERS rows.
COUNTERS = 4096
PRESERVED = ("inner", "left", "left_semi", "left_anti")


def heavy_keys(df: DataFrame, on: Sequence[str], share: float = SHARE) -> dict[int, float]:
    """Hash of each key (not null) with at least `share` of the rows, and the share. At most 2 / share entries."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    most = max(1, int(2 / share))
    counters = max(COUNTERS, 4 * most)
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    found = (
        df.where(known)
        .select(F.xxhash64(*on).alias("h"))
        .agg(F.expr(f"approx_top_k(h, {most}, {counters})").alias("top"), F.count(F.lit(1)).alias("n"))
        .first()
    )
    return {t["item"]: t["count"] / found["n"] for t in found["top"] or [] if t["count"] >= share * found["n"]}


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    share: float = SHARE,
    heavy: dict[int, float] | None = None,
) -> DataFrame:
    """`left.join(right, on, how)` with the hot keys of `left` dealt over several tasks.

    `how` must keep the left side whole or drop from it (inner, left, left_semi, left_anti). A null key matches
    nothing, and the rows that have one are dealt out too.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in PRESERVED:
        raise ValueError(f"Unknown or unsupported join: {how}")
    if heavy is None:
        heavy = heavy_keys(left, on, share)
    salts = {h: min(MAX_SALTS, int(s / share) + 1) for h, s in heavy.items()}
    name = "__salt"
    while name in left.columns or name in right.columns:
        name += "_"

    def count():
        h = F.xxhash64(*on)
        many = F.lit(1)
        for key, n in salts.items():
            many = F.when(h == key, n).otherwise(many)
        return many

    # A row's salt follows from its values and its partition: a task that runs again gives the same one, and
    # copies of one row are spread.
    plain = [c for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    deal = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(MAX_SALTS))
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    salted = left.withColumn(name, F.when(null, deal).otherwise(F.pmod(deal, count())).cast("int"))
    copied = right.withColumn(name, F.explode(F.sequence(F.lit(0), count() - 1)))
    return salted.join(copied, [*on, name], how).drop(name)


def lookup(
    left: DataFrame, side: DataFrame, on: str | Sequence[str], how: str = "inner", limit: int | None = None
) -> DataFrame:
    """Join a table with a side that is broadcast within the bounds of `small_side`, and joined by
    shuffle with hot keys split beyond them."""
    small = small_side(side) if limit is None else small_side(side, limit)
    if small is not side:
        return left.join(small, on, how)
    return salted_join(left, side, on, how)
