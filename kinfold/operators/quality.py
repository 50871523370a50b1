"""Clustering scores for given labels: silhouette, Calinski-Harabasz, Davies-Bouldin.

Calinski-Harabasz and Davies-Bouldin are linear: one or two grouped passes. The Euclidean
silhouette compares every row with every other and so is quadratic in the number of
*distinct* rows; its squared-Euclidean relative (`silhouette_squared`) is linear and is the
one to use on very large tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_vector, distance_expr
from ..session import cut_lineage
from .blocks import group_count
from .clusters import cluster_moments, small_side
from .kernels import distances, euclidean_tiles, fast_euclidean, to_matrix

# The score of a clustering that has nothing to compare.
ONE_LABEL = -1.0
MAX_BROADCAST_ROWS = 20_000
TILE_ROWS = 4096
#: Rows of a side that are compared at a time inside a task.
STEP = 512
# Summaries of at most this many clusters (one centre each) are finished on the driver.
SMALL_K = 2048


def _small(summary: DataFrame, cols: Sequence[str]) -> pa.Table | None:
    """The one-row-per-cluster summary if it is within the bound, else None."""
    fetched = summary.select(*cols).limit(SMALL_K + 1).toArrow()
    return fetched if fetched.num_rows <= SMALL_K else None


def _one(spark, name: str, value: float | None) -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} double")


# --- silhouette -----------------------------------------------------------


def silhouette(
    df: DataFrame,
    features: str | Sequence[str],
    cluster: str = "cluster",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    tile_rows: int | None = None,
) -> DataFrame:
    """One row: the mean of (b - a) / max(a, b) over all rows; a lone member scores 0, and a
    table with one label -1.

    Equal rows of a cluster are folded into one weighted point first. The points are then
    either broadcast (checked size) or met group by group; both ways each task sends back sums
    per cluster, never pairs.
    """
    points = (
        df.select(F.col(cluster).cast("long").alias("c"), as_vector(features).alias("v"))
        .groupBy("c", "v")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    fetched = points.limit(max_broadcast_rows + 1).toArrow()
    if fetched.num_rows <= max_broadcast_rows:
        return _silhouette_broadcast(points, fetched)
    grouped = _silhouette_groups(points.select("v", "w", F.array("c").alias("cs")), 1, tile_rows)
    if grouped is None:
        return _silhouette_tiles(points, tile_rows or TILE_ROWS)
    return _one(points.sparkSession, "silhouette", grouped[0])


def silhouettes(
    df: DataFrame, features: str | Sequence[str], clusters: Sequence[str], tile_rows: int | None = None
) -> list[float]:
    """The silhouette of every label column; the rows meet once for all of them."""
    labels = F.array(*[F.col(c).cast("long") for c in clusters]).alias("cs")
    points = df.select(as_vector(features).alias("v"), labels).groupBy("v", "cs")
    points = points.agg(F.count(F.lit(1)).cast("double").alias("w"))
    grouped = _silhouette_groups(points, len(clusters), tile_rows)
    return grouped or [silhouette(df, features, c).first()[0] for c in clusters]


def _silhouette_groups(points: DataFrame, models: int, tile_rows: int | None) -> list[float] | None:
    """The silhouette of each of the `models` labels in `cs`, or None with a missing or too many labels.

    Both sides are dealt into groups, and a task takes a pair: per row it sums the distances to every cluster of every
    model, as a product with the matrix of memberships. A row is copied once for each group of the other side.
    """
    points = cut_lineage(points.withColumn("id", F.monotonically_increasing_id()))
    found = points.select(F.posexplode("cs").alias("m", "c"), "w").groupBy("m", "c").agg(F.sum("w").alias("size"))
    found = found.orderBy("m", "c").limit(SMALL_K + 1).toArrow()  # one row per cluster
    if found.num_rows > SMALL_K or found.column("c").null_count:
        return None
    model, label = found.column("m").to_numpy(), found.column("c").to_numpy()
    size = found.column("size").to_numpy()
    bounds = np.searchsorted(model, np.arange(models + 1))
    names = [label[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if tile_rows is None:
        groups, others = group_count(n, max(width, len(label))), group_count(n, width)
    else:
        groups = others = max(1, math.ceil(n / tile_rows))
    chunks = 16
    spot = F.xxhash64("id")
    left = points.select("id", "v", "w", "cs", F.pmod(spot, F.lit(groups * chunks)).cast("int").alias("chunk"))
    left = left.withColumn("i", F.floor(F.col("chunk") / chunks).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    right = points.select(
        F.col("v").alias("v2"), F.col("w").alias("w2"), F.col("cs").alias("cs2"),
        F.pmod(spot, F.lit(others)).cast("int").alias("j2"),
    ).withColumn("i2", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def places(cs: pa.ChunkedArray) -> np.ndarray:
        """The column of each row's cluster, per model."""
        own = to_matrix(cs.cast(pa.list_(pa.float64()))).astype(np.int64)
        return np.stack([a + np.searchsorted(x, own[:, m]) for m, (a, x) in enumerate(zip(bounds, names))], axis=1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        total = np.zeros((a.num_rows, len(label)))
        if a.num_rows and b.num_rows:
            x, y, w = to_matrix(a.column("v")), to_matrix(b.column("v2")), b.column("w2").to_numpy()
            total = _sums(x, y, w, places(b.column("cs2")), len(label))
        ends = pa.array(np.arange(a.num_rows + 1, dtype=np.int32) * len(label))
        sums = pa.ListArray.from_arrays(ends, pa.array(total.ravel()))
        return a.select(["chunk", "id", "w", "cs"]).append_column("sums", sums)

    def finish(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        total = np.add.reduceat(to_matrix(t.column("sums"))[order], first, axis=0)
        rows = t.take(pa.array(order[first]))
        w, at = rows.column("w").to_numpy(), places(rows.column("cs"))
        score = [
            float(_scores(total[:, a:b], at[:, m] - a, size[a:b]) @ w) if b - a > 1 else 0.0
            for m, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
        ]
        return pa.table({"m": pa.array(range(models), pa.int32()), "score": score, "weight": [float(w.sum())] * models})

    met = (
        left.groupBy("i", "j")
        .cogroup(right.groupBy("i2", "j2"))
        .applyInArrow(meet, "chunk int, id long, w double, cs array<bigint>, sums array<double>")
    )
    parts = met.groupBy("chunk").applyInArrow(finish, "m int, score double, weight double")
    rows = parts.groupBy("m").agg(F.sum("score").alias("score"), F.sum("weight").alias("weight")).collect()
    means = {r["m"]: r["score"] / r["weight"] for r in rows}
    return [means[m] if len(names[m]) > 1 else ONE_LABEL for m in range(models)]


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, columns: int) -> np.ndarray:
    """(rows of x, columns): the sums of w[j] |x[i] - y[j]| over the rows j whose columns `at[j]` have the one asked for.

    Rows of one cluster are brought together, so that a step of them lies in few of the clusters of the other models.
    """
    order = np.lexsort(at.T)
    y, w, at = y[order], w[order], at[order]
    total, member = np.zeros((columns, len(x))), None
    for t, s, d in euclidean_tiles(y, x, STEP):
        if not s:
            used, place = np.unique(at[t : t + STEP], return_inverse=True)
            member = np.zeros((len(used), len(d)))
            np.put_along_axis(member, place.reshape(len(d), -1).T, w[None, t : t + STEP], axis=0)
        total[used, s : s + STEP] += member @ d
    return np.ascontiguousarray(total.T)


def _mean_score(parts: DataFrame) -> DataFrame:
    return parts.agg(F.try_divide(F.sum("score"), F.sum("weight")).alias("silhouette"))


def _silhouette_broadcast(points: DataFrame, fetched: pa.Table) -> DataFrame:
    labels = fetched.column("c").to_numpy()
    order = np.argsort(labels, kind="stable")
    names, starts = np.unique(labels[order], return_index=True)
    if len(names) == 1:
        return _one(points.sparkSession, "silhouette", ONE_LABEL)
    weights = fetched.column("w").to_numpy()[order]
    matrix = to_matrix(fetched.column("v"))[order] if len(order) else np.empty((0, 0))
    sizes = np.add.reduceat(weights, starts) if len(order) else weights
    shared = points.sparkSession.sparkContext.broadcast((matrix, weights, names, starts, sizes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x_all, w_all, c_all, at, n = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = to_matrix(b.column("v"))
            own = np.searchsorted(c_all, b.column("c").to_numpy())
            w = b.column("w").to_numpy()
            total = 0.0
            step = max(1, 4_000_000 // max(1, len(x_all)))
            for s in range(0, len(x), step):
                d = fast_euclidean(x[s : s + step], x_all)
                sums = np.add.reduceat(d * w_all, at, axis=1)
                total += _scores(sums, own[s : s + step], n) @ w[s : s + step]
            yield pa.RecordBatch.from_pydict({"score": [float(total)], "weight": [float(w.sum())]})

    return _mean_score(points.mapInArrow(score, "score double, weight double"))


def _scores(sums: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    rows = np.arange(len(own))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    s = np.divide(b - a, top, out=np.zeros(len(a)), where=top > 0)
    return np.where(sizes[own] > 1, s, 0.0)


def _silhouette_tiles(points: DataFrame, tile_rows: int) -> DataFrame:
    points = cut_lineage(points.withColumn("id", F.monotonically_increasing_id()))
    sizes = points.groupBy("c").agg(F.sum("w").alias("size")).persist()
    if sizes.count() == 1:
        sizes.unpersist()
        return _one(points.sparkSession, "silhouette", ONE_LABEL)
    n_blocks = max(1, math.ceil(points.count() / tile_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = points.select("id", "c", "v", block.alias("i")).withColumn("j", every)
    right = points.select(
        F.col("c").alias("c2"), F.col("v").alias("v2"), F.col("w").alias("w2"), block.alias("j2")
    ).withColumn("i2", every)

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"id": [], "c": [], "k": [], "sum": []}
        if a.num_rows and b.num_rows:
            label = b.column("c2").to_numpy()
            order = np.argsort(label, kind="stable")
            names, at = np.unique(label[order], return_index=True)
            x, w = to_matrix(b.column("v2"))[order], b.column("w2").to_numpy()[order]
            sums = np.add.reduceat(fast_euclidean(to_matrix(a.column("v")), x) * w, at, axis=1)
            out = {
                "id": np.repeat(a.column("id").to_numpy(), len(names)),
                "c": np.repeat(a.column("c").to_numpy(), len(names)),
                "k": np.tile(names, a.num_rows),
                "sum": sums.ravel(),
            }
        return pa.table(
            {
                "id": pa.array(out["id"], pa.int64()),
                "c": pa.array(out["c"], pa.int64()),
                "k": pa.array(out["k"], pa.int64()),
                "sum": pa.array(out["sum"], pa.float64()),
            }
        )

    sums = (
        left.groupBy("i", "j")
        .cogroup(right.groupBy("i2", "j2"))
        .applyInArrow(tile, "id long, c long, k long, sum double")
        .groupBy("id", "c", "k")
        .agg(F.sum("sum").alias("sum"))
        .join(small_side(sizes.withColumnRenamed("c", "k")), "k")
    )
    own = F.col("k") == F.col("c")
    each = sums.groupBy("id").agg(
        F.max(F.when(own, F.col("sum") / F.greatest(F.col("size") - 1, F.lit(1.0)))).alias("a"),
        F.min(F.when(~own, F.col("sum") / F.col("size"))).alias("b"),
        F.max(F.when(own, F.col("size"))).alias("size"),
    )
    s = F.when(
        F.col("size") > 1,
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)),
    ).otherwise(0.0)
    scored = each.select("id", s.alias("s")).join(points.select("id", "w"), "id")
    return _mean_score(
        scored.select((F.col("s") * F.col("w")).alias("score"), F.col("w").alias("weight"))
    )


def silhouette_squared(
    df: DataFrame, features: str | Sequence[str], cluster: str = "cluster"
) -> float:
    """Silhouette under squared Euclidean distance: a different number, in linear time.

    -1 for a table with fewer than two labels.
    """
    if df.select(cluster).distinct().limit(2).count() < 2:
        return ONE_LABEL
    data = df.select(
        array_to_vector(as_vector(features)).alias("features"),
        F.col(cluster).cast("double").alias("prediction"),
    )
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)


# --- Calinski-Harabasz ----------------------------------------------------


def calinski_harabasz(
    df: DataFrame, features: str | Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """One row: B (n - k) / (W (k - 1)); 1.0 when W is 0. One grouped pass over the table."""
    return _calinski_harabasz(cluster_moments(df, features, cluster))


def _calinski_harabasz(moments: DataFrame) -> DataFrame:
    few = _small(moments, ["n", "mean", "var"])
    if few is not None and few.num_rows:
        n = few.column("n").to_numpy().astype(float)
        mean, var = to_matrix(few.column("mean")), to_matrix(few.column("var"))
        centre = (n[:, None] * mean).sum(axis=0) / n.sum()
        between = (n[:, None] * (mean - centre) ** 2).sum()
        within = (n[:, None] * var).sum()
        k, total = len(n), n.sum()
        score = 1.0 if within == 0 or k < 2 else between * (total - k) / (within * (k - 1))
        return _one(moments.sparkSession, "calinski_harabasz", float(score))
    long = moments.select(
        "c", "n", F.posexplode(F.arrays_zip("mean", "var")).alias("j", "mv")
    ).select("c", "n", "j", "mv.mean", "mv.var")
    # Per feature: the clusters' means around the overall mean, by the population variance
    # of the means weighted with the cluster sizes.
    centre = long.groupBy("j").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"))
    gap = F.col("mean") - F.col("mu")
    parts = (
        long.join(small_side(centre), "j")
        .groupBy("c")
        .agg(
            F.max("n").alias("n"),
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.sum(F.col("n") * F.col("var")).alias("within"),
        )
    )
    k, n = F.count(F.lit(1)), F.sum("n")
    score = F.try_divide(F.sum("between") * (n - k), F.sum("within") * (k - 1))
    return parts.agg(F.coalesce(score, F.lit(1.0)).alias("calinski_harabasz"))


# --- Davies-Bouldin -------------------------------------------------------


def davies_bouldin(
    df: DataFrame,
    features: str | Sequence[str],
    cluster: str = "cluster",
    chunk: int = 20_000,
) -> DataFrame:
    """One row: mean over clusters of the worst (S_i + S_j) / d(c_i, c_j)."""
    moments = cluster_moments(df, features, cluster)
    return _davies_bouldin(df, features, cluster, moments, chunk)


def _davies_bouldin(df, features, cluster, moments: DataFrame, chunk: int = 20_000) -> DataFrame:
    centres = moments.select("c", "mean").persist()
    rows = df.select(F.col(cluster).cast("long").alias("c"), as_vector(features).alias("v"))
    rows = rows.join(small_side(centres), "c")
    spread = rows.groupBy("c").agg(F.avg(distance_expr(F.col("v"), F.col("mean"))).alias("s"))
    few = _small(spread.join(small_side(centres), "c"), ["c", "s", "mean"])
    if few is not None and few.num_rows:
        s, m = few.column("s").to_numpy(), to_matrix(few.column("mean"))
        ratio, gap = _ratios(few.column("c").to_numpy(), s, m, few.column("c").to_numpy(), s, m)
        flat = gap.max() < 1e-12 or s.max() < 1e-12
        return _one(df.sparkSession, "davies_bouldin", 0.0 if flat else float(ratio.mean()))
    table = cut_lineage(spread.join(centres, "c"))
    parts = max(1, math.ceil(table.count() / chunk))
    worst = None
    for i in range(parts):
        # A bounded slice of the centres per round; one round unless there are many clusters.
        some = table.where(F.pmod(F.xxhash64("c"), F.lit(parts)) == i).toArrow()
        out = table.mapInArrow(
            _worst_ratio(table.sparkSession, some), "c long, worst double, gap double, s double"
        )
        worst = out if worst is None else worst.unionByName(out)
    per_cluster = worst.groupBy("c").agg(
        F.max("worst").alias("worst"), F.max("gap").alias("gap"), F.max("s").alias("s")
    )
    flat_zero = (F.max("gap") < 1e-12) | (F.max("s") < 1e-12)
    return per_cluster.agg(
        F.when(flat_zero, F.lit(0.0)).otherwise(F.avg("worst")).alias("davies_bouldin")
    )


def _ratios(c, s, m, c2, s2, m2) -> tuple[np.ndarray, np.ndarray]:
    """Per cluster of the first set: worst spread-to-gap ratio and widest gap to the second."""
    if not len(c2):
        return np.zeros(len(c)), np.zeros(len(c))
    d = distances(m, m2)
    r = np.divide(np.add.outer(s, s2), d, out=np.zeros_like(d), where=d > 0)
    r[c[:, None] == c2[None, :]] = 0.0
    return r.max(axis=1), d.max(axis=1)


def _worst_ratio(spark, some: pa.Table):
    payload = (
        some.column("c").to_numpy(),
        some.column("s").to_numpy(),
        to_matrix(some.column("mean")),
    )
    shared = spark.sparkContext.broadcast(payload)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c2, s2, m2 = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            c, s, m = b.column("c").to_numpy(), b.column("s").to_numpy(), to_matrix(b.column("mean"))
            ratio, gap = _ratios(c, s, m, c2, s2, m2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()), pa.array(ratio), pa.array(gap), pa.array(s)],
                names=["c", "worst", "gap", "s"],
            )

    return worst


def centre_scores(
    df: DataFrame, features: str | Sequence[str], clusters: dict[str, int]
) -> list[tuple[float, float]] | None:
    """(Calinski-Harabasz, Davies-Bouldin) of every label column by two readings of the rows for all of them.

    `clusters` has the label columns, each with labels from 0 to below the number given. None where a row has no label,
    or with too many labels for the driver.
    """
    ends = np.cumsum([0, *clusters.values()])
    if ends[-1] > SMALL_K:
        return None
    labels = F.array(*[F.col(c).cast("double") for c in clusters]).alias("cs")
    rows = df.select(as_vector(features).alias("v"), labels)

    def read(add) -> np.ndarray | None:
        """The sums of `add(rows, columns of their clusters)`, one line per column, or None where a label is missing."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, lost = 0.0, 0
            for b in batches:
                lost += b.column("cs").flatten().null_count
                for i in range(0, 0 if lost else b.num_rows, STEP):
                    some = b.slice(i, STEP)
                    own = to_matrix(some.column("cs")).astype(np.int64) + ends[:-1]
                    total = total + add(to_matrix(some.column("v")), own)
            lines = [[float(lost)]] if lost else np.reshape(total, (-1, np.shape(total)[-1])).tolist() if np.ndim(total) else []
            at = [-1] if lost else range(len(lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(lines, pa.list_(pa.float64()))], names=["line", "s"]
            )

        parts = rows.mapInArrow(part, "line int, s array<double>").select("line", F.posexplode("s").alias("j", "s"))
        got = parts.groupBy("line", "j").agg(F.sum("s").alias("s")).orderBy("line", "j").toArrow()
        if not got.num_rows or got["line"][0].as_py() < 0:
            return None
        return got["s"].to_numpy().reshape(ends[-1], -1)

    def moments(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        member = np.zeros((ends[-1], len(x)))
        np.put_along_axis(member, own.T, 1.0, axis=0)
        return member @ np.concatenate([x, np.ones((len(x), 1)), (x * x).sum(axis=1)[:, None]], axis=1)

    found = read(moments)
    if found is None:
        return None
    n, squares = found[:, -2], found[:, -1]
    mean = found[:, :-2] / np.maximum(n, 1.0)[:, None]
    shared = df.sparkSession.sparkContext.broadcast(mean)

    def spreads(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.zeros((ends[-1], 2))
        for at in own.T:
            square = ((x - shared.value[at]) ** 2).sum(axis=1)
            out[:, 0] += np.bincount(at, np.sqrt(square), ends[-1])
            out[:, 1] += np.bincount(at, square, ends[-1])
        return out

    spread = read(spreads)
    scores = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        c = a + np.flatnonzero(n[a:b])
        k, total, m = len(c), n[c].sum(), mean[c]
        centre = (n[c, None] * m).sum(axis=0) / total
        between, within = (n[c, None] * (m - centre) ** 2).sum(), spread[c, 1].sum()
        # Copies of one row lie in their mean but for its rounding.
        flat = k < 2 or within <= 1e-30 * squares[c].sum()
        ratio, gap = _ratios(c, spread[c, 0] / n[c], m, c, spread[c, 0] / n[c], m)
        bouldin = 0.0 if gap.max() < 1e-12 or (spread[c, 0] / n[c]).max() < 1e-12 else float(ratio.mean())
        scores.append((1.0 if flat else float(between * (total - k) / (within * (k - 1))), bouldin))
    return scores


# --- all three ------------------------------------------------------------


def clustering_quality(
    df: DataFrame, features: str | Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """silhouette, calinski_harabasz, davies_bouldin; (-1, 0, +inf) for fewer than two labels."""
    moments = cluster_moments(df, features, cluster).persist()
    if moments.limit(2).count() < 2:
        return df.sparkSession.createDataFrame(
            [(-1.0, 0.0, float("inf"))],
            "silhouette double, calinski_harabasz double, davies_bouldin double",
        )
    scores = (
        silhouette(df, features, cluster),
        _calinski_harabasz(moments),
        _davies_bouldin(df, features, cluster, moments),
    )
    row = tuple(score.first()[0] for score in scores)
    moments.unpersist()
    return df.sparkSession.createDataFrame(
        [row], "silhouette double, calinski_harabasz double, davies_bouldin double"
    )
