"""Ward clustering over weighted centres, or over the distinct rows themselves.

The caller says which: `method="centres"` always reduces the table in Spark to `leaves` k-means centres
with their sizes and merges those, a step whose cost depends on `leaves` alone; `method="exact"` merges
the distinct rows, for small tables only, and refuses more than `MAX_EXACT` of them. The procedure never
changes with the size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_vector
from .kernels import to_matrix
from .kmeans import assign_nearest, fit_kmeans

LEAVES = 200
MAX_EXACT = 2000
METHODS = ("centres", "exact")


def hierarchical(
    df: DataFrame,
    features: str | Sequence[str],
    k: int,
    cluster: str = "cluster",
    method: str = "centres",
    leaves: int = LEAVES,
    seed: int = 42,
) -> DataFrame:
    """The table with a Ward label per row, labels ordered by their smallest leaf."""
    data, ids, centers, sizes = ward_leaves(df, features, method, leaves, seed)
    labels = cut_labels(ward_merges(centers, sizes), len(ids), k)
    return label_leaves(data, ids, labels, cluster)


def ward_leaves(
    df: DataFrame,
    features: str | Sequence[str],
    method: str = "centres",
    leaves: int = LEAVES,
    seed: int = 42,
) -> tuple[DataFrame, list[int], np.ndarray, np.ndarray]:
    """The table with its leaf per row (`__leaf`), and the leaves' ids, centres and sizes.

    At most `leaves` (or `MAX_EXACT`) rows are fetched.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method}")
    data = df.withColumn("__vec", as_vector(features))
    if method == "exact":
        distinct = data.groupBy(F.col("__vec").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        few = distinct.limit(MAX_EXACT + 1).toArrow()
        if few.num_rows > MAX_EXACT:
            raise ValueError(f'More than {MAX_EXACT} distinct rows; use method="centres"')
        centers = to_matrix(few.column("v"))
        order = np.lexsort(centers.T[::-1])
        centers, sizes = centers[order], few.column("n").to_numpy().astype(float)[order]
        ids = list(range(len(centers)))
        out = assign_nearest(data, "__vec", centers.tolist(), "__leaf") if ids else data
        return out, ids, centers, sizes
    fit = fit_kmeans(data, "__vec", leaves, n_init=1, seed=seed)
    data = assign_nearest(data, "__vec", fit.centers, "__leaf")
    few = data.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n")).orderBy("__leaf").toArrow()
    ids = few.column("__leaf").to_pylist()
    return data, ids, np.asarray(fit.centers)[ids], few.column("n").to_numpy().astype(float)


def label_leaves(data: DataFrame, ids: list[int], labels: np.ndarray, cluster: str) -> DataFrame:
    lookup = dict(zip(ids, labels.tolist(), strict=True))
    positions = F.array(*[F.lit(lookup.get(i, -1)) for i in range(max(ids) + 1)])
    out = data.withColumn(cluster, F.get(positions, F.col("__leaf")).cast("int"))
    return out.drop("__vec", "__leaf")


def ward_merges(centers: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges as (cost, member of one side, member of the other), by nearest-neighbour chains.

    The cost of joining A and B is |A||B| / (|A| + |B|) times their squared centre distance.
    """
    c, n = centers.copy(), sizes.copy()
    alive = np.ones(len(c), dtype=bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        tip = chain[-1]
        gap = ((c - c[tip]) ** 2).sum(axis=1)
        cost = np.where(alive, n * n[tip] / (n + n[tip]) * gap, np.inf)
        cost[tip] = np.inf
        best = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[best]:
            best = chain[-2]
            chain = chain[:-2]
            merges.append((float(cost[best]), tip, best))
            c[best] = (n[best] * c[best] + n[tip] * c[tip]) / (n[best] + n[tip])
            n[best] += n[tip]
            alive[tip] = False
        else:
            chain.append(best)
    return merges


def cut_labels(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of `n` leaves after the cheapest merges down to k groups; one merge list gives every k."""
    if k > n:
        raise ValueError(f"Cannot form {k} clusters from {n} distinct rows")
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.unique(np.array([root(i) for i in range(n)]), return_inverse=True)[1]
