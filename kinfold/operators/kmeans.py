"""K-means on `pyspark.ml`, choice of k, and assignment to fitted centres."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_vector
from .kernels import to_matrix
from .lloyd import LloydFit, advance, fit_many
from .quality import (
    MAX_BROADCAST_ROWS,
    ONE_LABEL,
    calinski_harabasz,
    centre_scores,
    clustering_quality,
    davies_bouldin,
    silhouette_squared,
    silhouettes,
)

N_INIT = 10
MAX_ITER = 300
# Above this many (centre, feature) terms the flat expression outgrows one JVM method.
FLAT_TERMS = 256
# A table of more rows than this is read by all cores, however few parts its files have.
SPREAD_ROWS = 20_000
# Draws of starts that run at once each hold the rows as objects; together about this many bytes on the whole cluster.
HELD_BYTES = 4 << 30
ROW_BYTES = 96


@dataclass(frozen=True)
class KMeansFit:
    features: list[str] | str
    centers: list[list[float]]
    cost: float
    model: KMeansModel

    @property
    def k(self) -> int:
        return len(self.centers)


def fit_kmeans(
    df: DataFrame,
    features: str | Sequence[str],
    k: int,
    n_init: int = N_INIT,
    max_iter: int = MAX_ITER,
    seed: int = 42,
    parallel: int = 8,
) -> KMeansFit:
    """Best of `n_init` seeded fits by training cost.

    `pyspark.ml` draws the starts of each seed (no iterations); the rounds that follow advance all seeds together,
    one reading of the persisted table a round (see `lloyd`). The draws read that table through a projection which
    is not persisted itself, so that `pyspark.ml` unpacks the rows once a seed and not once a pass.
    """
    v = as_vector(features)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(v)).alias("width")).first()
    at_once = max(1, min(parallel, n_init, HELD_BYTES // max(1, seen.n * (8 * (seen.width or 1) + ROW_BYTES))))
    data = spread(df.select(v.alias("v")), seen.n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        spark, rows = df.sparkSession, data.select(array_to_vector("v").alias("features"))

        @inheritable_thread_target(spark)
        def start(s: int) -> np.ndarray:
            return np.array(KMeans(k=k, maxIter=0, seed=s, featuresCol="features").fit(rows).clusterCenters())

        with ThreadPool(at_once) as pool:
            starts = pool.map(start, [seed + i for i in range(n_init)])
        settled, _, costs = advance(data, starts, max_iter)
    finally:
        data.unpersist()
    best = int(np.argmin(costs))
    # Centres in a fixed order, so the label of a cluster does not depend on the seed.
    centers = sorted([float(x) for x in c] for c in settled[best])
    names = features if isinstance(features, str) else list(features)
    return KMeansFit(names, centers, costs[best], _as_model(spark, centers))


def _as_model(spark: SparkSession, centers: list[list[float]]) -> KMeansModel:
    """A `pyspark.ml` model with these centres: drawn, all of them, from a table that holds nothing else."""
    table = spark.createDataFrame([(c,) for c in centers], "v array<double>")
    every = KMeans(k=max(2, len(centers)), maxIter=0, initMode="random", featuresCol="features")
    return every.fit(table.select(array_to_vector("v").alias("features")))


def assign_nearest(
    df: DataFrame,
    features: str | Sequence[str],
    centers: Sequence[Sequence[float]],
    cluster: str = "cluster",
    distance: str | None = None,
    labels: Sequence[int] | None = None,
) -> DataFrame:
    """Add the label of the nearest centre (lowest position on ties) and its distance.

    A row with a missing feature (null or NaN) gets a null label and distance.
    """
    if not len(centers):
        raise ValueError("There are no centers; fit first")
    labels = list(range(len(centers))) if labels is None else [int(x) for x in labels]
    terms = len(centers) * len(centers[0])
    if terms <= FLAT_TERMS and not isinstance(features, str):
        best = F.least(
            *[
                F.struct(
                    sum(
                        (
                            (F.col(c).cast("double") - F.lit(float(v)))
                            * (F.col(c).cast("double") - F.lit(float(v)))
                            for c, v in zip(features, center, strict=True)
                        ),
                        F.lit(0.0),
                    ).alias("d"),
                    F.lit(i).alias("i"),
                )
                for i, center in enumerate(centers)
            ],
            F.struct(F.lit(float("inf")).alias("d"), F.lit(len(centers)).alias("i")),
        )
        whole = F.lit(True)
        for c in features:
            x = F.col(c).cast("double")
            whole = whole & x.isNotNull() & ~F.isnan(x)
        out = df.withColumn("__best", F.when(whole, best))
        values = {cluster: F.get(F.array(*[F.lit(x) for x in labels]), F.col("__best.i"))}
        if distance:
            values[distance] = F.sqrt("__best.d")
        return out.withColumns(values).drop("__best")
    return _assign_arrow(df, features, centers, cluster, distance, labels)


def _whole_rows(v: pa.Array) -> np.ndarray:
    """Which vectors are present and have no missing value."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    present = ~v.is_null().to_numpy(zero_copy_only=False)
    flat = v.flatten()
    missing = np.isnan(flat.to_numpy(zero_copy_only=False).astype(float))
    if missing.any():
        sizes = np.zeros(len(v), np.int64)
        sizes[present] = v.value_lengths().filter(pa.array(present)).to_numpy()
        present[np.repeat(np.arange(len(v)), sizes)[missing]] = False
    return present


def _assign_arrow(df, features, centers, cluster, distance, labels) -> DataFrame:
    payload = (np.asarray(centers, dtype=float), np.asarray(labels, dtype=np.int32))
    shared = df.sparkSession.sparkContext.broadcast(payload)

    # Only the vectors go to Python; the other columns wait in the JVM.
    @F.arrow_udf("struct<label:int,distance:double>")
    def nearest(v: pa.Array) -> pa.Array:
        c, names = shared.value
        norms = (c * c).sum(axis=1)
        whole = _whole_rows(v)
        x = to_matrix(v.filter(pa.array(whole)))
        if not len(x):
            label, d = np.empty(0, np.int32), np.empty(0)
        else:
            score = norms[None, :] - 2.0 * (x @ c.T)
            # The product only shortlists; exact distances pick among near-equal centres.
            slack = 1e-12 * (1.0 + (x * x).sum(axis=1) + norms.max())
            r, j = np.nonzero(score <= (score.min(axis=1) + slack)[:, None])
            d = np.sqrt(((x[r] - c[j]) ** 2).sum(axis=1))
            order = np.lexsort((j, d, r))
            r, j, d = r[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            label, d = names[j[first]], d[first]
        labels, distances = np.zeros(len(v), np.int32), np.zeros(len(v))
        labels[whole], distances[whole] = label, d
        return pa.StructArray.from_arrays(
            [pa.array(labels, mask=~whole), pa.array(distances, mask=~whole)],
            ["label", "distance"],
        )

    out = df.withColumn("__best", nearest(as_vector(features)))
    values = {cluster: F.col("__best.label")}
    if distance:
        values[distance] = F.col("__best.distance")
    return out.withColumns(values).drop("__best")


def find_optimal_k(
    df: DataFrame,
    features: str | Sequence[str],
    max_k: int = 20,
    min_k: int = 2,
    n_init: int = N_INIT,
    seed: int = 42,
    silhouette: str = "exact",
) -> tuple[int, DataFrame]:
    """(best k, one row of scores per k), the best having the highest silhouette, lowest k first.

    `silhouette="exact"` is Euclidean over all rows; "squared" is the linear-time variant for
    very large tables.
    """
    fit, table = tune_k(df, features, max_k, min_k, n_init, seed, silhouette)
    return fit.k, table


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The table in parts enough for all cores, for work that goes over it many times."""
    parts = min(2 * df.sparkSession.sparkContext.defaultParallelism, rows // (SPREAD_ROWS // 8))
    return df.repartition(parts) if rows > SPREAD_ROWS and df.rdd.getNumPartitions() < parts else df


def tune_k(
    df: DataFrame,
    features: str | Sequence[str],
    max_k: int = 20,
    min_k: int = 2,
    n_init: int = N_INIT,
    seed: int = 42,
    silhouette: str = "exact",
) -> tuple[LloydFit, DataFrame]:
    """The fit of the best k, and the scores; all fits of all k advance together, pass by pass."""
    if silhouette not in ("exact", "squared"):
        raise ValueError(f"Unknown silhouette: {silhouette}")
    rows = df.count()
    data = points = spread(df.select(as_vector(features).alias("v")), rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ks = range(min_k, min(max_k, rows) + 1)
        tried = fit_many(data, "v", [(k, seed + i) for k in ks for i in range(n_init)])
        fits = {k: min((f for f in tried if f.k == k), key=lambda f: f.cost) for k in ks}
        labelled = ((k, assign_nearest(data, "v", f.centers)) for k, f in fits.items())
        # All labels are functions of the vector, so the rows are labelled and met once for all k. Equal fits count once.
        names = {}
        for f in fits.values():
            if str(f.centers) not in names:
                names[str(f.centers)] = name = f"k{f.k}"
                points = assign_nearest(points, "v", f.centers, name)
        of = {k: list(names).index(str(f.centers)) for k, f in fits.items()}
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
        known = linear = None
        if fits:
            counts = {name: len(fits[int(name[1:])].centers) for name in names.values()}
            linear = centre_scores(points, "v", counts)
        if linear is not None:
            linear = {k: linear[i] for k, i in of.items()}
        if silhouette == "exact" and (linear is not None or rows > MAX_BROADCAST_ROWS):
            met = silhouettes(points, "v", list(names.values()))
            known = {k: met[i] for k, i in of.items()}
        best, table = score_labels(labelled, "v", "cluster", silhouette, known, linear)
    finally:
        points.unpersist()
        data.unpersist()
    cost = F.create_map(*[F.lit(x) for k, f in fits.items() for x in (k, f.cost)])
    return fits[best], table.withColumn("cost", F.element_at(cost, F.col("k"))).select(
        "k", "silhouette", "calinski_harabasz", "davies_bouldin", "cost", "is_best"
    )


def score_labels(
    labelled: Iterable[tuple[int, DataFrame]],
    features: str | Sequence[str],
    cluster: str = "cluster",
    silhouette: str = "exact",
    known: dict[int, float] | None = None,
    linear: dict[int, tuple[float, float]] | None = None,
) -> tuple[int, DataFrame]:
    """(best k, one row of scores per k) for labelled tables; those with one label are left out.

    `known` holds silhouettes, `linear` the other two scores, that are already computed.
    """
    if silhouette not in ("exact", "squared"):
        raise ValueError(f"Unknown silhouette: {silhouette}")
    rows, spark = [], None
    for k, df in labelled:
        spark = df.sparkSession
        if silhouette == "exact" and known is None:
            q = clustering_quality(df, features, cluster).first()
            scores = (q["silhouette"], q["calinski_harabasz"], q["davies_bouldin"])
        else:
            scores = (known[k] if known is not None else silhouette_squared(df, features, cluster),)
            if scores[0] != ONE_LABEL and linear is not None:
                scores += linear[k]
            elif scores[0] != ONE_LABEL:
                scores += (
                    calinski_harabasz(df, features, cluster).first()[0],
                    davies_bouldin(df, features, cluster).first()[0],
                )
        if scores[0] != ONE_LABEL:
            rows.append((k, *scores))
    if not rows:
        raise ValueError("No valid clustering results found")
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    schema = "k int, silhouette double, calinski_harabasz double, davies_bouldin double"
    table = spark.createDataFrame(rows, schema)
    return best, table.withColumn("is_best", F.col("k") == best)
