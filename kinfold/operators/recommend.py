"""Similar-row queries over a labelled feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import similarity
from ..session import cut_lineage
from .clusters import small_side
from .knn import knn
from .sample import hash_order, sample_n, sample_per_group

N_NEIGHBORS = 20


def _finish(near: DataFrame, n: int, query_col: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(query_col).orderBy("distance", id_col)
    return (
        near.drop("rank")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .withColumn("similarity_score", similarity(F.col("distance")))
    )


def _bounded(near: DataFrame) -> DataFrame:
    """Few queries have few neighbours: broadcast those, so labels and rows of the big table are
    looked up where they lie instead of being shuffled. The search behind them is run here, once: looking at the
    size of many and joining them must not be a search each."""
    return small_side(cut_lineage(near))


def _first_rows(df: DataFrame | None, id_col: str, row_order: str | None) -> DataFrame | None:
    if df is None or row_order is None or row_order not in df.columns:
        return df
    # The rank is cut before the shuffle too, so an id that many rows share stays small.
    w = Window.partitionBy(id_col).orderBy(row_order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def one_row_per_id(df: DataFrame, id_col: str, row_order: str | None = None) -> DataFrame:
    """The first row of each id by `row_order`; without an order, the table itself if no id repeats."""
    if row_order is not None:
        return _first_rows(df, id_col, row_order)
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col).first()
    if repeated is not None:
        raise ValueError(f"id {repeated[0]!r} is repeated; give row_order to choose one row per id")
    return df


def _with_rows(recs: DataFrame, rows: DataFrame | None, id_col: str) -> DataFrame:
    return recs if rows is None else _bounded(recs).join(rows, id_col)


def similar(
    df: DataFrame,
    *,
    id_col: str,
    features: str | Sequence[str],
    ids: DataFrame | None = None,
    n: int = 10,
    cluster: str | None = "cluster",
    mode: str = "postfilter",
    n_neighbors: int = N_NEIGHBORS,
    metric: str = "euclidean",
    p: float = 2.0,
    rows: DataFrame | None = None,
    query_col: str = "query_id",
    row_order: str | None = None,
    **plan,
) -> DataFrame:
    """Rows similar to known rows, the row itself left out.

    `ids` is a table with an `id_col` column (default: every row asks). Unknown ids give no
    rows. `mode`:

    * `postfilter` - take the `n_neighbors` + 1 nearest of the whole table, then keep those in
      the query's cluster; fewer than `n` results are normal, and `n` above `n_neighbors` is an
      error, as it could never be filled.
    * `any` - the nearest without the cluster test.
    * `prefilter` - search only the query's cluster, so `n` results come back when it has them.

    An id stands for one row. Where ids repeat, `row_order` names the column whose smallest value marks the
    row that counts (also in `rows`, if it has that column); without it repeated ids are an error.

    `rows` adds the columns of a (raw) table to each result.
    """
    if mode not in ("postfilter", "any", "prefilter"):
        raise ValueError(f"Unknown mode: {mode}")
    if mode == "postfilter" and n > n_neighbors:
        raise ValueError(f"n ({n}) must not exceed n_neighbors ({n_neighbors}); use prefilter or any")
    if mode == "any":
        n_neighbors = max(n, n_neighbors)
    df, rows = one_row_per_id(df, id_col, row_order), _first_rows(rows, id_col, row_order)
    queries = None
    if ids is not None:
        wanted = ids.select(id_col).distinct()
        queries = df.join(small_side(wanted), id_col, "left_semi")
    pre = mode == "prefilter"
    near = knn(
        df,
        queries,
        id_col=id_col,
        features=features,
        k=n + 1 if pre else n_neighbors + 1,
        metric=metric,
        p=p,
        within=cluster if pre else None,
        query_col=query_col,
        **plan,
    )
    near = near.where(F.col(query_col) != F.col(id_col))
    if mode == "postfilter":
        label = df.select(id_col, F.col(cluster).alias("__cluster"))
        own = label.select(F.col(id_col).alias(query_col), F.col("__cluster").alias("__own"))
        near = (
            _bounded(near)
            .join(own, query_col)
            .join(label, id_col)
            .where(F.col("__cluster") == F.col("__own"))
            .drop("__cluster", "__own")
        )
    return _with_rows(_finish(near, n, query_col, id_col), rows, id_col)


def query_status(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Each asked id with the reason it has no recommendations: null, or `not in table` (e.g. a
    row that outlier removal dropped after a search on the raw table found it)."""
    asked = ids.select(id_col).distinct()
    known = df.join(small_side(asked), id_col, "left_semi").select(id_col).distinct()
    return asked.join(known.withColumn("__known", F.lit(True)), id_col, "left").select(
        id_col, F.when(F.col("__known").isNull(), F.lit("not in table")).alias("reason")
    )


def similar_to_vectors(
    df: DataFrame,
    vectors: DataFrame,
    *,
    id_col: str,
    features: str | Sequence[str],
    vector_id: str,
    n: int = 10,
    cluster: str | None = None,
    wanted_cluster: str | None = None,
    n_neighbors: int = N_NEIGHBORS,
    metric: str = "euclidean",
    p: float = 2.0,
    rows: DataFrame | None = None,
    query_col: str = "query_id",
    **plan,
) -> DataFrame:
    """Rows similar to vectors that need not be in the table; an equal row is kept (distance 0).

    `vectors` has `vector_id` and the features; with `wanted_cluster` (a column of `vectors`)
    results are kept only when their `cluster` equals it, nulls meaning any.
    """
    if wanted_cluster is None:
        n_neighbors = max(n, n_neighbors)
    elif n > n_neighbors:
        raise ValueError(f"n ({n}) must not exceed n_neighbors ({n_neighbors})")
    queries = vectors
    if vector_id != id_col:
        queries = vectors.drop(id_col).withColumnRenamed(vector_id, id_col)
    near = knn(
        df,
        queries,
        id_col=id_col,
        features=features,
        k=n_neighbors + 1,
        metric=metric,
        p=p,
        query_col=query_col,
        **plan,
    )
    if wanted_cluster is not None:
        own = vectors.select(F.col(vector_id).alias(query_col), F.col(wanted_cluster).alias("__own"))
        label = df.select(id_col, F.col(cluster).alias("__cluster"))
        near = (
            _bounded(near.join(small_side(own), query_col))
            .join(label, id_col)
            .where("__own is null or __cluster = __own")
            .drop("__cluster", "__own")
        )
    return _with_rows(_finish(near, n, query_col, id_col), rows, id_col)


def recommend_by_cluster(
    df: DataFrame,
    *,
    id_col: str,
    n: int = 20,
    cluster: str = "cluster",
    cluster_id: int | None = None,
    exclude: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """`n` repeatably random rows of one cluster (or of each), similarity 1 and distance 0."""
    if exclude is not None:
        df = df.join(small_side(exclude.select(id_col).distinct()), id_col, "left_anti")
    if cluster_id is None:
        out = sample_per_group(df, id_col, cluster, n, seed)
    else:
        out = df.where(F.col(cluster) == cluster_id).orderBy(hash_order(id_col, seed), id_col)
        out = out.limit(n)
    return out.withColumns({"similarity_score": F.lit(1.0), "distance": F.lit(0.0)})


def batch_recommend(
    df: DataFrame, *, id_col: str, n_queries: int = 3, n: int = 3, seed: int = 42, **kw
) -> DataFrame:
    """Recommendations for a repeatable sample of rows."""
    ids = sample_n(df, id_col, n_queries, seed).select(id_col)
    return similar(df, id_col=id_col, ids=ids, n=n, **kw)


def recommendation_summary(recs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, similarity and distance statistics; for no rows 0 / 0.0 and null distances."""
    zero = F.lit(0.0)
    score, dist = F.col("similarity_score"), F.col("distance")
    return recs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_recommendations"),
        F.coalesce(F.avg(score), zero).alias("avg_similarity"),
        F.coalesce(F.min(score), zero).alias("min_similarity"),
        F.coalesce(F.max(score), zero).alias("max_similarity"),
        F.coalesce(F.avg(dist), zero).alias("avg_distance"),
        F.min(dist).alias("min_distance"),
        F.max(dist).alias("max_distance"),
    )
