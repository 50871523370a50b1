"""Fitted state on disk: small parameter tables next to the labelled feature table."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import FeatureProcessor
from ..operators.clustering import ClusterModel


def _save(spark: SparkSession, path: str, kind: str, state: dict, mark: str = "") -> None:
    row = [(kind, mark, json.dumps(state))]
    spark.createDataFrame(row, "kind string, fingerprint string, state string").coalesce(
        1
    ).write.mode("overwrite").parquet(path)


def _load(spark: SparkSession, path: str, kind: str) -> tuple[str, dict]:
    row = spark.read.parquet(path).where(F.col("kind") == kind).first()
    if row is None:
        raise ValueError(f"No {kind} stored at {path}")
    return row["fingerprint"], json.loads(row["state"])


def save_processor(spark: SparkSession, processor: FeatureProcessor, path: str, mark="") -> None:
    _save(spark, path, "processor", processor.to_dict(), mark)


def load_processor(spark: SparkSession, path: str) -> FeatureProcessor:
    return FeatureProcessor.from_dict(_load(spark, path, "processor")[1])


def save_clusters(spark: SparkSession, model: ClusterModel, path: str, mark="") -> None:
    _save(spark, path, "clusters", asdict(model), mark)


def load_clusters(spark: SparkSession, path: str) -> ClusterModel:
    return ClusterModel(**_load(spark, path, "clusters")[1])


def save_kmeans(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_kmeans(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def save_recommender(df: DataFrame, path: str, settings: dict, by_cluster: str | None = None) -> None:
    """The feature table with its labels, optionally laid out by cluster for pre-filtered search."""
    writer = df.write.mode("overwrite")
    if by_cluster:
        writer = writer.partitionBy(by_cluster)
    writer.parquet(f"{path}/table")
    _save(df.sparkSession, f"{path}/settings", "recommender", settings)


def load_recommender(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/table"), _load(spark, f"{path}/settings", "recommender")[1]


def fingerprint(
    df: DataFrame, features: list[str], settings: dict | None = None, id_col: str | None = None
) -> str:
    """Feature names, row count, an order-free checksum of the rows' ids and feature values, and the
    settings of the fit, so that another algorithm, k or seed, or the same features under other ids, is
    another fit."""
    ids = [] if id_col is None else [F.col(id_col)]
    h = F.xxhash64(*ids, *[F.col(c).cast("double") for c in features]).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return json.dumps([list(features), row["n"], str(row["h"]), settings], sort_keys=True, default=str)


def folder_of(mark: str) -> str:
    """A folder name for what belongs to one fingerprint."""
    return sha256(mark.encode()).hexdigest()[:32]


def fit_or_load(
    spark: SparkSession,
    path: str,
    mark: str,
    load: Callable[[SparkSession, str], object],
    fit: Callable[[], object],
    save: Callable[..., None],
) -> object:
    """The stored state if its fingerprint matches the data, else a new fit, stored."""
    try:
        stored = spark.read.parquet(path).select("fingerprint").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is not None and stored["fingerprint"] == mark:
        return load(spark, path)
    fresh = fit()
    save(spark, fresh, path, mark)
    return fresh
