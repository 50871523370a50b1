"""Tables about a labelled feature table: statistics, names, overview, membership.

The label is an ordinary column; -1 marks noise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import feature_level, mood_from_vector, mood_name, percent_text, title_case
from ..functions.vectors import as_vector
from ..presets import MOOD_DEFAULT, MOOD_RULES
from .clean import nan_as_null

NOISE_LABEL = -1

# Bounds of a table that is fetched once and broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table as a broadcast side if it is within the bounds, else as it is.

    A small table is evaluated here, once, so that checking its size does not mean computing
    it twice; a large one stays lazy and AQE plans its join, splitting hot keys.
    """
    fetched = df.limit(limit + 1).toArrow()
    if fetched.num_rows > limit or fetched.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, df.schema))


def cluster_moments(
    df: DataFrame, features: str | Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """c, n, mean and population-variance vectors per cluster, by one vector aggregate."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(F.col("v"))
    grouped = (
        df.select(
            F.col(cluster).cast("long").alias("c"), array_to_vector(as_vector(features)).alias("v")
        )
        .groupBy("c")
        .agg(summary.alias("s"))
    )
    unbias = F.try_divide(F.col("n") - 1, F.col("n"))
    return grouped.select(
        "c",
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("sample_var"),
    ).select("c", "n", "mean", F.transform("sample_var", lambda x: x * unbias).alias("var"))


def cluster_stats(
    df: DataFrame, features: str | Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """size, percentage of all rows (noise counted), mean and population-std vectors.

    Feature columns may miss values (null or NaN), which count for no mean; a vector column must be whole.
    """
    if not isinstance(features, str):
        df = nan_as_null(df, list(features))
    if isinstance(features, str):
        grouped = cluster_moments(df, features, cluster).select(
            F.col("c").cast("int").alias("cluster_id"),
            F.col("n").alias("size"),
            F.col("mean").alias("mean_features"),
            F.transform("var", F.sqrt).alias("std_features"),
        )
    else:
        grouped = df.groupBy(F.col(cluster).cast("int").alias("cluster_id")).agg(
            F.count(F.lit(1)).alias("size"),
            F.array(*[F.avg(F.col(c).cast("double")) for c in features]).alias("mean_features"),
            F.array(*[F.stddev_pop(F.col(c).cast("double")) for c in features]).alias(
                "std_features"
            ),
        )
    total = df.agg(F.count(F.lit(1))).scalar()
    return grouped.where(F.col("cluster_id") != NOISE_LABEL).select(
        "cluster_id",
        "size",
        (F.col("size") * F.lit(100.0) / total).alias("percentage"),
        "mean_features",
        "std_features",
    )


def mood_labels(stats: DataFrame, rules=MOOD_RULES, default: str = MOOD_DEFAULT) -> DataFrame:
    """cluster_id, mood from the first three entries of each mean vector."""
    return stats.select(
        "cluster_id",
        mood_from_vector(F.col("mean_features"), rules=rules, default=default).alias("mood"),
    )


def mood_labels_by_axes(
    df: DataFrame,
    danceability: Column,
    energy: Column,
    valence: Column,
    cluster: str = "cluster",
    digits: int | None = None,
    rules=MOOD_RULES,
    default: str = MOOD_DEFAULT,
) -> DataFrame:
    """Name clusters straight from three expressions, without building mean vectors.

    `digits` rounds each mean before the rule, for data that sits on the thresholds.
    """
    means = df.groupBy(F.col(cluster).alias("cluster_id")).agg(
        F.avg(danceability).alias("danceability"),
        F.avg(energy).alias("energy"),
        F.avg(valence).alias("valence"),
    )
    axes = ["danceability", "energy", "valence"]
    if digits is not None:
        means = means.withColumns({a: F.round(a, digits) for a in axes})
    named = mood_name(*[F.col(a) for a in axes], rules=rules, default=default)
    return means.where(F.col("cluster_id") != NOISE_LABEL).select(
        "cluster_id", *axes, named.alias("mood")
    )


def default_mood(cluster: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


def attach_moods(
    df: DataFrame,
    moods: DataFrame,
    cluster: str = "cluster",
    default: str | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left lookup of the mood name; unmatched rows get `Cluster <id>` or `default`.

    More than `limit` names are joined by shuffle, with the rows of hot clusters dealt over several tasks.
    """
    from .skew import lookup

    fallback = default_mood(F.col(cluster)) if default is None else F.lit(default)
    named = lookup(df, moods.select(F.col("cluster_id").alias(cluster), "mood"), cluster, "left", limit)
    return named.withColumn("mood", F.coalesce("mood", fallback))


def cluster_info(stats: DataFrame, moods: DataFrame, cluster_id: int) -> DataFrame:
    """Statistics and mood of one cluster; raises if there is no such cluster."""
    hit = stats.where(F.col("cluster_id") == cluster_id)
    if hit.isEmpty():
        raise ValueError(f"Cluster {cluster_id} not found")
    return hit.join(
        moods.where(F.col("cluster_id") == cluster_id), "cluster_id", "left"
    ).withColumn("mood", F.coalesce("mood", F.lit("Unknown")))


def cluster_overview(stats: DataFrame, moods: DataFrame) -> DataFrame:
    """Mood, size and percentage text per cluster."""
    return stats.join(small_side(moods), "cluster_id", "left").select(
        "cluster_id",
        F.coalesce("mood", F.lit("Unknown")).alias("mood"),
        F.col("size").alias("songs"),
        percent_text(F.col("percentage")).alias("percentage"),
    )


def overview_totals(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Row count and cluster count, noise not being a cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.sum("size").alias("n_rows"),
        F.count_if(F.col(cluster) != NOISE_LABEL).alias("n_clusters"),
    )


def feature_levels(
    stats: DataFrame, features: Sequence[str], first: int = 5
) -> DataFrame:
    """High / Medium / Low for the first features of each cluster."""
    names = F.array(*[F.lit(c) for c in list(features)[:first]])
    return (
        stats.select(
            "cluster_id",
            F.posexplode(F.slice("mean_features", 1, first)).alias("position", "mean"),
        )
        .withColumn("feature", F.get(names, F.col("position")))
        .select(
            "cluster_id",
            "position",
            "feature",
            title_case(F.col("feature")).alias("feature_title"),
            "mean",
            feature_level(F.col("mean")).alias("level"),
        )
    )


def cluster_members(df: DataFrame, cluster_id: int, cluster: str = "cluster") -> DataFrame:
    return df.where(F.col(cluster) == cluster_id)


def align_labels(
    rows: DataFrame, labels: DataFrame, id_col: str, strict: bool = True
) -> DataFrame:
    """Attach labels kept in a second table; `strict` demands one label for every row and back.

    The check is one count of both tables by id: ids that one side lacks or that either repeats are errors.
    """
    if strict:
        sides = [t.select(F.col(id_col).alias("id"), F.lit(i).alias("side")) for i, t in enumerate((rows, labels))]
        both = sides[0].unionByName(sides[1])
        by_id = both.groupBy("id").agg(F.count_if(F.expr("side = 0")).alias("r"), F.count_if(F.expr("side = 1")).alias("l"))
        c = by_id.agg(
            F.coalesce(F.sum("r"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("l"), F.lit(0)).alias("labels"),
            F.count_if(F.expr("l = 0 or id is null and r > 0")).alias("unlabelled"),
            F.count_if(F.expr("r = 0 or id is null and l > 0")).alias("unused"),
            F.count_if(F.expr("r > 1 or l > 1")).alias("repeated"),
        ).first()
        if c["rows"] != c["labels"]:
            raise ValueError(f"Tables must have the same length: {c['rows']} rows, {c['labels']} labels")
        for n, what in ((c["unlabelled"], "rows without a label"), (c["unused"], "labels without a row")):
            if n:
                raise ValueError(f"Tables must have the same ids: {n} {what}")
        if c["repeated"]:
            raise ValueError(f"Tables must have each id once: {c['repeated']} ids are repeated")
    return rows.join(labels, id_col)
