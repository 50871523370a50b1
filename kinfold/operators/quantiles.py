"""Exact quantiles (linear interpolation) without holding a column in one task.

Spark's `percentile` keeps a value -> count map of the whole column in one aggregation
buffer, so it is used up to `direct_limit` values only. Beyond, the ranks are bracketed: a
mergeable sketch gives two data values around each rank, and one more pass counts the rows
below the bracket and gathers the few values inside it. Where a bracket would still hold too
many values it is narrowed again. Every pass is a partial aggregation with bounded state, so a
column, or a group with any share of the rows, never meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most values of a column (or of a group's column) counted in one buffer.
DIRECT_LIMIT = 100_000
# Most values gathered for one rank.
BRACKET_LIMIT = 20_000
# A sketch places a rank within n / ACCURACY of its true position.
ACCURACY = 10_000


def _slack(accuracy: int) -> float:
    return 2.0 / accuracy


def _most_inside(n: int, accuracy: int) -> int:
    """Most values a first bracket can hold: the slack and the sketch error on both sides."""
    return math.ceil(n * 2 * (_slack(accuracy) + 1.0 / accuracy)) + 2


def _levels(probs: Sequence[float], accuracy: int) -> list[float]:
    s = _slack(accuracy)
    return [min(1.0, max(0.0, p + d)) for p in probs for d in (-s, s)]


def column_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    direct_limit: int = DIRECT_LIMIT,
    bracket_limit: int = BRACKET_LIMIT,
    accuracy: int = ACCURACY,
) -> dict[str, list[float] | None]:
    """Quantiles of whole columns; None for a column of nulls."""
    cols = list(cols)
    values = [F.col(c).cast("double") for c in cols]
    counts = df.agg(*[F.count(v) for v in values]).first()
    out: dict[str, list[float] | None] = dict.fromkeys(cols)
    small = [i for i in range(len(cols)) if 0 < counts[i] <= direct_limit]
    if small:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(values[i], levels).alias(f"q{i}") for i in small]).first()
        out |= {cols[i]: list(row[f"q{i}"]) for i in small}
    large = [i for i in range(len(cols)) if counts[i] > direct_limit]
    if not large:
        return out

    sketch = df.agg(
        *[
            F.percentile_approx(values[i], _levels(probs, accuracy), accuracy).alias(f"g{i}")
            for i in large
        ]
    ).first()
    # One target per (column, rank): the rank lies strictly between the values lo and hi
    # (None: unbounded), with `below` values <= lo and `inside` values in between.
    targets, answers = {}, {}
    for i in large:
        n = counts[i]
        for j, p in enumerate(probs):
            low, high, _ = _ranks(p, n)
            lo, hi = sketch[f"g{i}"][2 * j : 2 * j + 2]
            for r in {low, high}:
                targets[(i, r)] = {"lo": None, "hi": None, "below": 0, "inside": n, "try": (lo, hi)}
    while targets:
        _count_brackets(df, values, targets, answers, bracket_limit, accuracy)
        if targets:
            _sketch_brackets(df, values, targets, accuracy)
    for i in large:
        found = []
        for p in probs:
            low, high, weight = _ranks(p, counts[i])
            a, b = answers[(i, low)], answers[(i, high)]
            found.append(a + weight * (b - a))
        out[cols[i]] = found
    return out


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    """The two ranks (from 0) around quantile p, and the weight of the upper one."""
    x = p * (n - 1)
    low = math.floor(x)
    return low, min(low + 1, n - 1), x - low


def _inside(v: Column, lo: float | None, hi: float | None) -> Column:
    above = F.lit(True) if lo is None else v > F.lit(lo)
    under = F.lit(True) if hi is None else v < F.lit(hi)
    return above & under


def _count_brackets(df, values, targets, answers, bracket_limit, accuracy) -> None:
    """One pass: place every target against its tried bracket, gathering the inside if small."""
    aggs, gathered = [], set()
    # Neighbouring ranks share a bracket, and then its counts.
    tries = sorted({(i, *t["try"]) for (i, _), t in targets.items()})
    most = {}
    for (i, _), t in targets.items():
        key = (i, *t["try"])
        most[key] = max(most.get(key, 0), _most_inside(t["inside"], accuracy))
    for b, (i, lo, hi) in enumerate(tries):
        v = values[i]
        aggs += [
            F.count_if(v < lo).alias(f"lt_lo{b}"),
            F.count_if(v <= lo).alias(f"le_lo{b}"),
            F.count_if(v < hi).alias(f"lt_hi{b}"),
            F.count_if(v <= hi).alias(f"le_hi{b}"),
        ]
        if most[(i, lo, hi)] <= bracket_limit and lo < hi:
            gathered.add(b)
            aggs.append(F.collect_list(F.when(_inside(v, lo, hi), v)).alias(f"v{b}"))
    row = df.agg(*aggs).first()
    sorted_values = {b: sorted(row[f"v{b}"]) for b in gathered}
    index = {key: b for b, key in enumerate(tries)}
    for (i, r), t in list(targets.items()):
        lo, hi = t["try"]
        b = index[(i, lo, hi)]
        lt_lo, le_lo, lt_hi, le_hi = (row[f"{x}{b}"] for x in ("lt_lo", "le_lo", "lt_hi", "le_hi"))
        if lt_lo <= r < le_lo:
            answers[(i, r)] = lo
        elif lt_hi <= r < le_hi:
            answers[(i, r)] = hi
        elif le_lo <= r < lt_hi and b in gathered:
            answers[(i, r)] = sorted_values[b][r - le_lo]
        elif r < lt_lo:
            t.update(hi=lo, inside=lt_lo - t["below"])
        elif r >= le_hi:
            t.update(lo=hi, inside=t["inside"] - (le_hi - t["below"]), below=le_hi)
        else:
            t.update(lo=lo, hi=hi, below=le_lo, inside=lt_hi - le_lo)
        if (i, r) in answers:
            del targets[(i, r)]


def _sketch_brackets(df, values, targets, accuracy) -> None:
    """One pass: a tighter bracket for every open target, from a sketch of its inside."""
    aggs = []
    for b, ((i, r), t) in enumerate(targets.items()):
        q = (r - t["below"]) / max(1, t["inside"] - 1)
        inside = F.when(_inside(values[i], t["lo"], t["hi"]), values[i])
        aggs.append(F.percentile_approx(inside, _levels([q], accuracy), accuracy).alias(f"g{b}"))
    row = df.agg(*aggs).first()
    for b, t in enumerate(targets.values()):
        t["try"] = tuple(row[f"g{b}"])


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    direct_limit: int = DIRECT_LIMIT,
    bracket_limit: int = BRACKET_LIMIT,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: the group columns and, per feature, `array<double>` of quantiles.

    Nulls are ignored; a group with no value gives a null array.
    """
    cols, by = list(cols), list(by)
    if not by:
        found = column_quantiles(df, cols, probs, direct_limit, bracket_limit, accuracy)

        def literal(xs):
            return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.lit(None).cast("array<double>")

        return df.sparkSession.range(1).select(*[literal(found[c]).alias(c) for c in cols])
    counts = df.groupBy(*by).agg(
        F.greatest(*[F.count(c) for c in cols], F.lit(0).cast("long")).alias("__n")
    )
    if (counts.agg(F.max("__n")).first()[0] or 0) <= direct_limit:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), levels).alias(c) for c in cols]
        )
    return _narrowed(df, cols, probs, by, bracket_limit, accuracy)


# Ranks wanted per query are few; above this many (group, feature, rank) rows the
# brackets are joined by shuffle instead of broadcast.
BROADCAST_TARGETS = 200_000
GRID = 400


def _narrowed(df, cols, probs, by, bracket_limit, accuracy) -> DataFrame:
    feature_value = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v"))
                for i, c in enumerate(cols)
            ]
        )
    )
    # Group columns get names of their own while the work columns are around.
    groups = [f"__by{i}" for i in range(len(by))]
    named = [F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]
    values = df.select(*named, feature_value.alias("fv")).select(*groups, "fv.f", "fv.v")
    values = values.where("v is not null")
    keys = [*groups, "f"]
    totals = values.groupBy(*keys).agg(F.count("v").alias("total")).persist()

    levels = F.array(
        *[F.struct(F.lit(j).alias("p"), F.lit(float(p)).alias("level")) for j, p in enumerate(probs)]
    )
    wanted = (
        totals.select(*keys, "total", F.explode(levels).alias("l"))
        .select(*keys, "total", "l.p", (F.col("l.level") * (F.col("total") - 1)).alias("x"))
        .withColumn("low", F.floor("x").cast("long"))
        .withColumn("high", F.least(F.col("low") + 1, F.col("total") - 1))
    )
    # A target is one rank `r` (0-based) known to lie strictly between the data
    # values lo and hi; `below` values are <= lo and `n` lie inside.
    targets = (
        wanted.select(*keys, "total", F.explode(F.array("low", "high")).alias("r"))
        .distinct()
        .select(
            *keys,
            "r",
            F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"),
            F.lit(0).cast("long").alias("below"),
            F.col("total").alias("n"),
        )
    )
    columns = [*keys, "r", "lo", "hi", "below", "n"]
    above_lo = F.coalesce(F.col("v") > F.col("lo"), F.lit(True))
    under_hi = F.coalesce(F.col("v") < F.col("hi"), F.lit(True))

    def with_targets(t: DataFrame) -> DataFrame:
        few = t.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
        return values.join(F.broadcast(t) if few else t, keys)

    found = None
    while True:
        small = targets.where(F.col("n") <= bracket_limit)
        large = targets.where(F.col("n") > bracket_limit)
        sorted_values = (
            with_targets(small)
            .where(above_lo & under_hi)
            .groupBy(*columns)
            .agg(F.sort_array(F.collect_list("v")).alias("vs"))
        )
        at = (F.col("r") - F.col("below")).cast("int")
        hits = sorted_values.select(*keys, "r", F.get("vs", at).alias("value"))
        found = hits if found is None else found.unionByName(hits)
        if large.isEmpty():
            break

        sketch = (
            with_targets(large)
            .where(above_lo & under_hi)
            .groupBy(*columns)
            .agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], accuracy).alias("g"))
        )
        q = (F.col("r") - F.col("below")) / F.col("n")
        slack = 4.0 / accuracy
        low_at = F.floor((q - slack) * GRID).cast("int")
        high_at = (F.ceil((q + slack) * GRID) + 1).cast("int")
        brackets = sketch.select(
            *keys,
            "r",
            F.when(low_at >= 0, F.get("g", low_at)).otherwise(F.col("lo")).alias("lo"),
            F.when(high_at <= GRID, F.get("g", high_at)).otherwise(F.col("hi")).alias("hi"),
        ).persist()
        v_le_lo = F.coalesce(F.col("v") <= F.col("lo"), F.lit(False))
        step = (
            with_targets(brackets)
            .groupBy(*keys, "r", "lo", "hi")
            .agg(F.count_if(v_le_lo).alias("below"), F.count_if(above_lo & under_hi).alias("n"))
            .persist()
        )
        # The rank may land on a bracket end itself, e.g. on a value shared by many rows.
        on_lo = F.col("r") < F.col("below")
        on_hi = F.col("r") >= F.col("below") + F.col("n")
        found = found.unionByName(
            step.where(on_lo | on_hi).select(
                *keys, "r", F.when(on_lo, F.col("lo")).otherwise(F.col("hi")).alias("value")
            )
        )
        targets = step.where(~on_lo & ~on_hi).select(*columns)

    low = found.select(*keys, F.col("r").alias("low"), F.col("value").alias("a"))
    high = found.select(*keys, F.col("r").alias("high"), F.col("value").alias("b"))
    each = (
        wanted.join(low, [*keys, "low"])
        .join(high, [*keys, "high"])
        .select(
            *keys,
            "p",
            (F.col("a") + (F.col("x") - F.col("low")) * (F.col("b") - F.col("a"))).alias("q"),
        )
    )
    back = [F.col(g).alias(c) for g, c in zip(groups, by, strict=True)]
    return each.groupBy(*back).agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("f") == i, F.struct("p", "q")))),
                lambda s: s["q"],
            ).alias(c)
            for i, c in enumerate(cols)
        ]
    )
