"""Balanced label propagation: documents with equal text move together into shards of even size.

The graph links documents of equal text, so a document's neighbours are its group, and all that matters of
a group is how many of its documents each shard holds. Starting from a hash of the id, each round lets a
group's documents move to the shard that holds most of them. A shard takes at most its quota: the room it
has left for linked documents plus a part of what leaves it, so a group moves whole with the probability
that keeps the expected arrivals within the quota, and a group too large for that moves in part. Afterwards
every shard gets its exact share of rows: linked documents keep their shard as far as its share goes, and
documents without links, for which any shard is as good, fill the rest. The law is `rows`: counts of any two
shards differ by one at most.

Everything is a join, a grouped sum or a window whose groups are cut into parts, so that neither a shard nor a
hot group is one task's work. The driver sees shard-by-shard sums only.

Defined results: null text is empty (size 1, crc32 0) and forms one group with empty texts; repeated rows are
a group like others and each keeps its own slot; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 8
ROUNDS = 6
#: Parts that ranks inside a shard or a group are counted by.
PARTS = 256
#: A move of more than this share of a shard is admitted in part rather than as a whole.
LARGE = 1 / 64


def ranked(df: DataFrame, keys: list[str], spread: Column, order: list, name: str) -> DataFrame:
    """`df` with a gapless rank from 0 inside `keys`, in the order of (part of `spread`, `order`)."""
    d = df.withColumn("__part", F.pmod(spread, F.lit(PARTS)).cast("int"))
    w = Window.partitionBy(*keys, "__part").orderBy(*order)
    d = d.withColumn("__rn", F.row_number().over(w))
    sizes = d.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    offsets = sizes.select(*keys, "__part", before.alias("__before"))
    return (
        d.join(offsets, [*keys, "__part"])
        .withColumn(name, F.col("__before") + F.col("__rn") - 1)
        .drop("__part", "__rn", "__n", "__before")
    )


def _choose(index: Column, values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index + 1)


def _sums(df: DataFrame, key: str, value: str, shards: int) -> list[int]:
    """Totals by shard (as many rows as there are shards)."""
    got = {r[0]: r[1] for r in df.groupBy(key).agg(F.sum(value)).collect()}
    return [int(got.get(s) or 0) for s in range(shards)]


def _propagate(state: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """`state` (`g`, `s`, `n`: documents of group g in shard s) after the rounds of moves."""
    share = -(-total // shards)
    for r in range(rounds):
        load = _sums(state, "s", "n", shards)
        best = state.groupBy("g").agg(F.max(F.struct("n", (-F.col("s")).alias("neg"))).alias("b"))
        aim = state.join(best.select("g", (-F.col("b.neg")).alias("t")), "g")
        moves = aim.where("s <> t")
        enter, leave = _sums(moves, "t", "n", shards), _sums(moves, "s", "n", shards)
        if not sum(enter):
            break
        admit = [
            max(0.0, min(1.0, (1.02 * share - load[t] + 0.5 * leave[t]) / enter[t])) if enter[t] else 0.0
            for t in range(shards)
        ]
        f = _choose(F.col("t"), admit, "double")
        chance = F.pmod(F.xxhash64("g", F.lit(r)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        whole = F.when(chance < f, F.col("n")).otherwise(0)
        moved = F.when(F.col("n") > LARGE * share, F.floor(F.col("n") * f)).otherwise(whole).cast("long")
        steps = aim.withColumn("moved", F.when(F.col("s") == F.col("t"), F.lit(0)).otherwise(moved))
        state = materialise(
            steps.select("g", "s", (F.col("n") - F.col("moved")).alias("n"))
            .unionByName(steps.select("g", F.col("t").alias("s"), F.col("moved").alias("n")))
            .where("n > 0")
            .groupBy("g", "s")
            .agg(F.sum("n").alias("n")),
            "shard-state",
        )
    return state


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """A row per document: id, `size`, `text_crc32`, `shard`, `slot`, and `g`, a hash of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(t, F.crc32(t.cast("binary"))).alias("g"),
        ),
        "shard-base",
    )
    total = base.count()
    groups = materialise(
        base.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shard-groups"
    )
    of_id = F.xxhash64("id", "g")
    linked = base.join(groups.select("g"), "g")
    start = linked.groupBy("g", F.pmod(of_id, F.lit(shards)).cast("int").alias("s")).agg(
        F.count(F.lit(1)).alias("n")
    )
    state = _propagate(materialise(start, "shard-state"), total, shards, rounds)

    # Documents of a group are alike: the first n of them go to its first shard, and so on.
    up_to = F.sum("n").over(Window.partitionBy("g").orderBy("s"))
    bounds = (
        state.withColumn("upto", up_to)
        .groupBy("g")
        .agg(F.array_sort(F.collect_list(F.struct("upto", "s"))).alias("bounds"))
    )
    bounds = materialise(bounds, "shard-bounds")
    placed = ranked(linked, ["g"], of_id, ["id", "size"], "k").join(bounds, "g")
    spot = F.get(F.filter("bounds", lambda b: b["upto"] > F.col("k")), F.lit(0))
    placed = placed.withColumn("s", spot["s"]).drop("bounds")
    # A shard keeps its linked documents up to its share; the order keeps small groups in one part.
    share = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    spread = F.xxhash64("g") + F.floor(F.col("k") / F.lit(max(1, total // (shards * PARTS))))
    placed = materialise(ranked(placed, ["s"], spread, ["g", "k"], "at").drop("k"), "shard-linked")
    held = placed.where(F.col("at") < _choose(F.col("s"), share, "bigint")).drop("at")
    evicted = placed.where(F.col("at") >= _choose(F.col("s"), share, "bigint")).drop("at", "s")
    loose = base.join(groups.select("g"), "g", "left_anti").select(evicted.columns)
    got = _sums(held.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", "n", shards)
    ends, run = [], 0
    for s in range(shards):
        run += share[s] - got[s]
        ends.append(run)
    free = loose.unionByName(evicted).withColumn("all", F.lit(0))
    free = ranked(free, ["all"], of_id, ["id", "g"], "at").drop("all")
    first_free = F.get(
        F.filter(
            F.array(*[F.struct(F.lit(e).alias("end"), F.lit(s).alias("s")) for s, e in enumerate(ends)]),
            lambda b: b["end"] > F.col("at"),
        ),
        F.lit(0),
    )
    free = free.withColumn("s", first_free["s"]).drop("at")
    final = materialise(held.unionByName(free), "shard-final")
    out = ranked(final, ["s"], of_id, ["id", "g"], "slot")
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("s").alias("shard"), "slot", "g"
    )
