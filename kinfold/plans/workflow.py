"""The end-to-end job: prepare, cluster, report, recommend."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import clusters, recommend, report
from ..operators.clean import FeatureProcessor
from ..operators.clustering import ClusterModel, fit_clusters
from ..operators.pca import pca_scatter
from ..presets import FEATURE_SETS, available
from ..sources import state

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Recommender:
    """A labelled feature table ready for similar-row questions."""

    table: DataFrame
    id_col: str
    features: list[str]
    cluster: str = "cluster"
    n_neighbors: int = 20
    metric: str = "euclidean"
    p: float = 2.0
    rows: DataFrame | None = None

    def _shared(self) -> dict:
        return {
            "id_col": self.id_col,
            "features": self.features,
            "n_neighbors": self.n_neighbors,
            "metric": self.metric,
            "p": self.p,
            "rows": self.rows,
        }

    def _ids(self, ids) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids
        kind = dict(self.table.dtypes)[self.id_col]
        return self.table.sparkSession.createDataFrame([(i,) for i in ids], f"`{self.id_col}` {kind}")

    def similar(self, ids, n: int = 10, mode: str = "postfilter", **plan) -> DataFrame:
        return recommend.similar(
            self.table, ids=self._ids(ids), n=n, mode=mode, cluster=self.cluster,
            **self._shared(), **plan,
        )

    def similar_to_vectors(self, vectors: DataFrame, vector_id: str, n: int = 10, **kw) -> DataFrame:
        return recommend.similar_to_vectors(
            self.table, vectors, vector_id=vector_id, n=n, cluster=self.cluster, **self._shared(), **kw
        )

    def by_cluster(self, cluster_id: int | None, n: int = 20, exclude=None, seed=42) -> DataFrame:
        return recommend.recommend_by_cluster(
            self.table, id_col=self.id_col, n=n, cluster=self.cluster, cluster_id=cluster_id,
            exclude=None if exclude is None else self._ids(exclude), seed=seed,
        )

    def members(self, cluster_id: int) -> DataFrame:
        return clusters.cluster_members(self.table, cluster_id, self.cluster)

    def save(self, path: str) -> None:
        settings = {
            "id_col": self.id_col, "features": self.features, "cluster": self.cluster,
            "n_neighbors": self.n_neighbors, "metric": self.metric, "p": self.p,
        }
        state.save_recommender(self.table, path, settings)

    @classmethod
    def load(cls, spark, path: str) -> Recommender:
        table, settings = state.load_recommender(spark, path)
        return cls(table=table, **settings)


def build_recommender(
    rows: DataFrame, labels: DataFrame | None, id_col: str, features: Sequence[str], **kw
) -> Recommender:
    """From one labelled table, or from rows and labels of equal length joined by key."""
    table = rows if labels is None else clusters.align_labels(rows, labels, id_col)
    return Recommender(table=table, id_col=id_col, features=list(features), **kw)


@dataclass(frozen=True)
class Analysis:
    processor: FeatureProcessor
    model: ClusterModel
    prepared: DataFrame
    raw: DataFrame
    moods: DataFrame
    recommender: Recommender

    def overview(self) -> DataFrame:
        stats = clusters.cluster_stats(self.prepared, self.model.features)
        return clusters.cluster_overview(stats, self.moods)


def analyse(
    df: DataFrame,
    id_col: str,
    feature_set: str | Sequence[str] = "continuous",
    processor: FeatureProcessor | None = None,
    state_dir: str | None = None,
    report_dir: str | None = None,
    **fit,
) -> Analysis:
    """Run the whole analysis; with `state_dir` fitted parts are reused when the data match."""
    spark = df.sparkSession
    processor = processor or FeatureProcessor()
    fitted, prepared = processor.fit_transform(df)
    wanted = FEATURE_SETS[feature_set] if isinstance(feature_set, str) else list(feature_set)
    features = available(prepared.columns, wanted)
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)

    labels, mark, kept = None, "", ""
    if state_dir is not None:
        settings = {**processor.to_dict(), "params": None, "fit": fit}
        mark = state.fingerprint(prepared, features, settings, id_col)
        # Under the mark, so that an earlier analysis keeps the labels that it reads.
        kept = f"{state_dir}/labels/{state.folder_of(mark)}"

    def make() -> ClusterModel:
        nonlocal labels
        model, labels = fit_clusters(prepared, features, id_col=id_col, **fit)
        if model.algorithm == "kmeans":
            return model
        # Labels that no centre can give again: kept, so that nothing clusters twice.
        if state_dir is None:
            labels = labels.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            labels.select(id_col, "cluster").write.mode("overwrite").parquet(kept)
        return model

    if state_dir is None:
        model = make()
    else:
        state.save_processor(spark, fitted, f"{state_dir}/processor", mark)
        model = state.fit_or_load(
            spark, f"{state_dir}/clusters", mark, state.load_clusters, make, state.save_clusters
        )
    if model.algorithm == "kmeans":
        labelled = model.predict(prepared)
    elif state_dir is None:
        labelled = labels
    else:
        labelled = prepared.join(spark.read.parquet(kept), id_col)
    moods = spark.createDataFrame(
        list(model.mood_labels.items()), "cluster_id int, mood string"
    )
    labelled_raw = df.join(labelled.select(id_col, "cluster"), id_col)
    recommender = Recommender(labelled, id_col, features, rows=df.drop(*["cluster"]))
    if state_dir is not None:
        recommender.save(f"{state_dir}/recommender")
    result = Analysis(fitted, model, labelled, labelled_raw, moods, recommender)
    if report_dir is not None:
        save_reports(result, id_col, features, report_dir)
    return result


def save_reports(result: Analysis, id_col: str, features: Sequence[str], path: str) -> dict[str, bool]:
    """Write the plot-ready tables; one that fails is logged and does not stop the others."""
    raw = available(result.raw.columns, list(features))
    with_mood = clusters.attach_moods(result.raw, result.moods)
    tables = {
        "scatter": lambda: pca_scatter(result.prepared, id_col, features, moods=result.moods),
        "distribution": lambda: report.boxplot_stats(with_mood, raw),
        "distribution_outliers": lambda: report.boxplot_outliers(with_mood, id_col, raw),
        "heatmap": lambda: report.cluster_heatmap(result.raw, raw, result.moods),
        "overview": result.overview,
    }
    done = {}
    for name, make in tables.items():
        try:
            make().write.mode("overwrite").parquet(f"{path}/{name}")
            done[name] = True
        except Exception:
            log.exception("report %s failed", name)
            done[name] = False
    return done


def demo_recommendations(result: Analysis, id_col: str, n_queries: int = 3, n: int = 3) -> DataFrame:
    return recommend.batch_recommend(
        result.prepared, id_col=id_col, features=result.model.features, n_queries=n_queries, n=n,
        rows=result.recommender.rows,
    )


def summary(result: Analysis) -> DataFrame:
    return clusters.overview_totals(result.prepared)
