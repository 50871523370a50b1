"""Clustering a feature table: one entry point over the three algorithms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..presets import MOOD_DEFAULT, MOOD_RULES
from . import clusters
from .dbscan import dbscan
from .hierarchy import LEAVES, cut_labels, label_leaves, ward_leaves, ward_merges
from .kmeans import N_INIT, assign_nearest, fit_kmeans, score_labels, tune_k

ALGORITHMS = ("kmeans", "dbscan", "agglomerative")
DEFAULT_K = 8


@dataclass(frozen=True)
class ClusterModel:
    """What is needed to label new rows and answer questions about the clusters."""

    algorithm: str
    features: list[str]
    labels: list[int]
    centers: list[list[float]]
    sizes: list[int]
    percentages: list[float]
    stds: list[list[float]]
    moods: list[str]
    params: dict = field(default_factory=dict)

    @property
    def n_clusters(self) -> int:
        return len(self.labels)

    @property
    def mood_labels(self) -> dict[int, str]:
        return dict(zip(self.labels, self.moods, strict=True))

    def predict(self, df: DataFrame, cluster: str = "cluster") -> DataFrame:
        """The nearest cluster centre per row: k-means centres, or the clusters' mean vectors."""
        return assign_nearest(df, self.features, self.centers, cluster, labels=self.labels)

    def info(self, cluster_id: int) -> dict:
        if cluster_id not in self.labels:
            raise ValueError(f"Cluster {cluster_id} not found")
        i = self.labels.index(cluster_id)
        return {
            "cluster_id": cluster_id,
            "mood_label": self.moods[i],
            "size": self.sizes[i],
            "percentage": self.percentages[i],
            "mean_features": self.centers[i],
            "std_features": self.stds[i],
        }


def fit_clusters(
    df: DataFrame,
    features: Sequence[str],
    algorithm: str = "kmeans",
    k: int | None = None,
    auto_tune: bool = True,
    id_col: str | None = None,
    cluster: str = "cluster",
    eps: float = 0.5,
    min_samples: int = 5,
    max_k: int = 20,
    min_k: int = 2,
    n_init: int = N_INIT,
    seed: int = 42,
    silhouette: str = "exact",
    label_on: Sequence[str] | None = None,
    ward_method: str = "centres",
    leaves: int = LEAVES,
    mood_rules=MOOD_RULES,
    mood_default: str = MOOD_DEFAULT,
) -> tuple[ClusterModel, DataFrame]:
    """The fitted model and the labelled table.

    Without `k`, `auto_tune` tries `min_k`..`max_k` by silhouette with the algorithm asked for
    (one list of Ward merges gives every k), else k is 8; dbscan needs no k but an `id_col`. Clusters are named from the means of `features`, or of the columns
    given as `label_on` (e.g. the unscaled features).
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown clustering algorithm: {algorithm}")
    features = list(features)
    scores = None
    if algorithm != "dbscan" and k is None and not auto_tune:
        k = DEFAULT_K
    if algorithm == "kmeans" and k is None:
        # The labels are those that were scored.
        fit, scores = tune_k(df, features, max_k, min_k, n_init, seed, silhouette)
        k = fit.k
    elif algorithm == "kmeans":
        fit = fit_kmeans(df, features, k, n_init=n_init, seed=seed)
    if algorithm == "kmeans":
        labelled = assign_nearest(df, features, fit.centers, cluster)
    elif algorithm == "dbscan":
        if id_col is None:
            raise ValueError("dbscan needs id_col")
        labelled = dbscan(df, id_col, features, eps, min_samples, cluster)
    else:
        data, ids, centers, sizes = ward_leaves(df, features, ward_method, leaves, seed)
        merges = ward_merges(centers, sizes)
        if k is None:
            ks = range(min_k, min(max_k, len(ids)) + 1)
            cuts = ((i, label_leaves(data, ids, cut_labels(merges, len(ids), i), cluster)) for i in ks)
            k, scores = score_labels(cuts, features, cluster, silhouette)
        labelled = label_leaves(data, ids, cut_labels(merges, len(ids), k), cluster)

    stats = clusters.cluster_stats(labelled, features, cluster)
    named = stats if label_on is None else clusters.cluster_stats(labelled, label_on, cluster)
    moods = clusters.mood_labels(named, mood_rules, mood_default)
    # One row per cluster.
    rows = stats.join(moods, "cluster_id").orderBy("cluster_id").collect()
    centers = [list(r["mean_features"]) for r in rows]
    if algorithm == "kmeans":
        centers = [fit.centers[r["cluster_id"]] for r in rows]
    model = ClusterModel(
        algorithm=algorithm,
        features=features,
        labels=[r["cluster_id"] for r in rows],
        centers=centers,
        sizes=[r["size"] for r in rows],
        percentages=[r["percentage"] for r in rows],
        stds=[list(r["std_features"]) for r in rows],
        moods=[r["mood"] for r in rows],
        params={
            "k": k,
            "eps": eps,
            "min_samples": min_samples,
            "seed": seed,
            "scores": [r.asDict() for r in scores.collect()] if scores is not None else [],
        },
    )
    return model, labelled.withColumn(cluster, F.col(cluster).cast("int"))
