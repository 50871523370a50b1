"""Two-dimensional PCA for scatter reports, on `pyspark.ml`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_vector
from .clusters import attach_moods


@dataclass(frozen=True)
class Projection:
    mean: list[float]
    components: list[list[float]]
    explained_variance_ratio: list[float]


def fit_pca(df: DataFrame, features: str | Sequence[str], n_components: int = 2) -> Projection:
    """Components signed so that the largest loading of each is positive."""
    data = df.select(array_to_vector(as_vector(features)).alias("v"))
    mean = data.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    model = PCA(k=n_components, inputCol="v", outputCol="p").fit(data)
    loadings = model.pc.toArray().T
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])
    loadings = loadings * np.where(signs == 0, 1.0, signs)[:, None]
    return Projection(
        mean.tolist(), loadings.tolist(), model.explainedVariance.toArray().tolist()
    )


def project(
    df: DataFrame, features: str | Sequence[str], fit: Projection, names=("x", "y")
) -> DataFrame:
    """Add the centred projections as columns."""
    v = as_vector(features)
    out = {}
    for name, weights in zip(names, fit.components, strict=False):
        offset = float(np.dot(fit.mean, weights))
        w = F.array(*[F.lit(x) for x in weights])
        dot = F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
        out[name] = dot - F.lit(offset)
    return df.withColumns(out)


def pca_scatter(
    df: DataFrame,
    id_col: str,
    features: str | Sequence[str],
    cluster: str = "cluster",
    moods: DataFrame | None = None,
) -> DataFrame:
    """id, x, y, cluster, mood; noise rows are kept."""
    placed = project(df, features, fit_pca(df, features)).select(id_col, "x", "y", cluster)
    if moods is None:
        return placed
    return attach_moods(placed, moods, cluster)
