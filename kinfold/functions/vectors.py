"""Vector columns: `array<double>` built from feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "manhattan", "minkowski")


def as_vector(features: str | Sequence[str]) -> Column:
    """One array column from a list of feature columns, or an existing array column."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def euclidean_to_literal(cols: Sequence[Column], point: Sequence[float]) -> Column:
    """Distance to a fitted point as one flat arithmetic expression (no lambda, so codegen'd)."""
    terms = [(c.cast("double") - F.lit(float(v))) for c, v in zip(cols, point, strict=True)]
    return F.sqrt(reduce(add, [t * t for t in terms]))


def distance_expr(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Row-wise distance of two array columns that already sit in the same row."""
    zero = F.lit(0.0)

    def fold(pair):
        return F.aggregate(F.zip_with(a, b, pair), zero, lambda s, x: s + x)

    if metric == "euclidean" or (metric == "minkowski" and p == 2.0):
        return F.sqrt(fold(lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return fold(lambda x, y: F.abs(x - y))
    if metric == "minkowski":
        return F.pow(fold(lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))
    if metric == "cosine":
        norms = F.sqrt(fold(lambda x, y: x * x) * fold(lambda x, y: y * y))
        return F.lit(1.0) - F.coalesce(F.try_divide(fold(lambda x, y: x * y), norms), zero)
    raise ValueError(f"Unknown metric: {metric}")
