"""Plot-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import display_label, domain_scale
from ..presets import FEATURE_DOMAINS
from .clean import nan_as_null
from .clusters import NOISE_LABEL, attach_moods
from .quantiles import exact_quantiles
from .skew import lookup


def unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (keys, feature, value), expanded inside the scan stage."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        list(keys), list(features), "feature", "value"
    )


def cluster_heatmap(
    df: DataFrame, features: Sequence[str], moods: DataFrame, cluster: str = "cluster"
) -> DataFrame:
    """Mean of each feature per cluster id, noise left out, in long form with the mood name."""
    features = list(features)
    wide = (
        nan_as_null(df, features)
        .where(F.col(cluster) != NOISE_LABEL)
        .groupBy(cluster)
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features])
    )
    return unpivot(attach_moods(wide, moods, cluster), [cluster, "mood"], features).withColumnRenamed(
        "value", "mean"
    )


def boxplot_stats(df: DataFrame, features: Sequence[str], group: str = "mood") -> DataFrame:
    """Quartiles, 1.5-IQR fences, whiskers and outlier counts per (group, feature)."""
    features = list(features)
    df = nan_as_null(df, features)
    boxes = _boxes(df, features, group)
    long = unpivot(df, [group], features).where("value is not null")
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return (
        lookup(long, boxes, [group, "feature"])
        .groupBy(group, "feature", "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def boxplot_outliers(
    df: DataFrame, id_col: str, features: Sequence[str], group: str = "mood"
) -> DataFrame:
    """The points beyond the fences."""
    features = list(features)
    df = nan_as_null(df, features)
    return (
        lookup(unpivot(df, [id_col, group], features), _boxes(df, features, group), [group, "feature"])
        .where((F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence")))
        .select(id_col, group, "feature", "value")
    )


def _boxes(df: DataFrame, features: list[str], group: str) -> DataFrame:
    quartiles = exact_quantiles(df, features, [0.25, 0.5, 0.75], by=[group])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("q")) for c in features]
    long = quartiles.select(group, F.explode(F.array(*rows)).alias("r")).select(
        group,
        "r.feature",
        F.get("r.q", F.lit(0)).alias("q1"),
        F.get("r.q", F.lit(1)).alias("median"),
        F.get("r.q", F.lit(2)).alias("q3"),
    )
    step = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return long.withColumns(
        {"low_fence": F.col("q1") - step, "high_fence": F.col("q3") + step}
    )


def radar_profile(
    df: DataFrame, id_col: str, domains: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Features placed in their fixed domains, in long form; unknown features are left out."""
    domains = FEATURE_DOMAINS if domains is None else domains
    known = [c for c in domains if c in df.columns]
    if not known:
        kind = dict(df.dtypes)[id_col]
        return df.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, feature string, value double"
        )
    scaled = df.select(id_col, *[domain_scale(F.col(c), *domains[c]).alias(c) for c in known])
    return unpivot(scaled, [id_col], known)


def compare_recommendations(
    rows: DataFrame,
    recommendations: DataFrame,
    id_col: str,
    features: Sequence[str],
    label_cols: Sequence[str] = (),
    top: int = 5,
    query_col: str = "query_id",
) -> DataFrame:
    """Raw feature values of each query row next to its first recommendations.

    Series 0 is the query, series r its r-th recommendation. `rows` is the raw
    table; features it lacks and null values show as 0.
    """
    features, labels = list(features), [c for c in label_cols if c in rows.columns]
    values = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)).alias(
            c
        )
        for c in features
    ]
    picked = recommendations.where(F.col("rank") <= top)
    queries = picked.select(query_col).distinct()
    wanted = queries.select(
        query_col, F.lit(0).alias("series"), F.col(query_col).alias(id_col)
    ).unionByName(picked.select(query_col, F.col("rank").cast("int").alias("series"), id_col))
    name = (
        F.when(F.col("series") == 0, F.lit("Query Track")).otherwise(
            display_label([F.col(c) for c in labels]) if labels else F.col(id_col).cast("string")
        )
    )
    raw = rows.select(id_col, *labels, *values)
    named = wanted.join(raw, id_col).withColumn("series_name", name)
    return unpivot(named, [query_col, "series", "series_name"], features)
