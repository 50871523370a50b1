"""Column expressions; everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..presets import MOOD_AXES, MOOD_DEFAULT, MOOD_RULES

# sin/cos of a multiple of pi leaves noise of this size instead of zero.
NOISE = 1e-12


def nan_to_null(c: Column) -> Column:
    """Missing numbers are NULL in this engine; NaN would sort as the largest value."""
    # One mention of the column, so an input computed on the fly is computed once.
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def circular_pair(c: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle; float noise around zero is snapped to zero."""
    angle = F.lit(2.0) * F.pi() * c.cast("double") / F.lit(float(period))

    def snap(x: Column) -> Column:
        return F.when(F.abs(x) < NOISE, F.lit(0.0)).otherwise(x)

    return snap(F.sin(angle)), snap(F.cos(angle))


def domain_scale(c: Column, low: float, high: float) -> Column:
    """Place a value in a fixed domain; values outside the domain are not clamped."""
    return (c.cast("double") - F.lit(low)) / F.lit(high - low)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def feature_level(mean: Column, high: float = 0.5, low: float = -0.5) -> Column:
    return F.when(mean > high, "High").when(mean < low, "Low").otherwise("Medium")


def mood_name(
    danceability: Column,
    energy: Column,
    valence: Column,
    rules=MOOD_RULES,
    default: str = MOOD_DEFAULT,
) -> Column:
    """First matching rule over three means; a missing mean counts as 0."""
    axes = {"danceability": danceability, "energy": energy, "valence": valence}
    axes = {name: F.coalesce(c, F.lit(0.0)) for name, c in axes.items()}
    out = None
    for name, tests in rules:
        cond = F.lit(True)
        for axis, op, bound in tests:
            cond = cond & (axes[axis] > bound if op == ">" else axes[axis] < bound)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(default) if out is None else out.otherwise(default)


def mood_from_vector(means: Column, **kw) -> Column:
    """`mood_name` over an array of means; positions beyond the array count as 0."""
    picked = {axis: F.get(means, F.lit(pos)) for axis, pos in MOOD_AXES.items()}
    return mood_name(**picked, **kw)


def display_label(parts: Iterable[Column], default: str = "Unknown") -> Column:
    return F.concat_ws(" - ", *[F.coalesce(p.cast("string"), F.lit(default)) for p in parts])


def whole_seconds(milliseconds: Column) -> Column:
    return F.floor(milliseconds / F.lit(1000)).cast("long")


def percent_text(c: Column) -> Column:
    """One decimal, rounded by the exact binary value with ties to even.

    Formatting alone would round 91.05 by its printed digits, though the stored value lies
    just below; the lost part of c * 10 tells on which side of a tie the value is.
    """
    a, b = c * F.lit(8.0), c * F.lit(2.0)
    ten = a + b
    lost = b - (ten - a)
    tie = (ten - F.floor(ten)) == 0.5
    tenths = F.when(tie & (lost > 0), F.ceil(ten).cast("double"))
    tenths = tenths.when(tie & (lost < 0), F.floor(ten).cast("double")).otherwise(F.rint(ten))
    return F.format_string("%.1f%%", tenths / F.lit(10.0))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
