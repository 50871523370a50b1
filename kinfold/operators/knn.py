"""Exact k nearest neighbours of many query rows.

Two plans give the same answer:

* `scan` - the query vectors fit a checked bound, so they are broadcast and the table is read
  once. Each task keeps k candidates per query; only those are shuffled.
* `tiles` - any number of queries. Rows are cut into bounded blocks around pivots (see
  `blocks`). A block's own rows give an upper bound for its k-th distances; the triangle
  inequality then rules out most other blocks. The pairs of blocks left are worked on by pairs of
  groups of blocks, one task each, which sends back k candidates per query row. Copies of a vector are
  searched once and at most k of them can be neighbours, so a vector shared by many rows stays cheap.

Ties in distance are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_vector
from ..session import cut_lineage
from .blocks import BLOCK_ROWS, MAX_PIVOTS, block_list, block_matrix, choose_pivots, group_count, pack_blocks
from .kernels import check_metric, distances, id_array, keep_top, nearest, to_matrix

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20


def knn(
    points: DataFrame,
    queries: DataFrame | None = None,
    *,
    id_col: str,
    features: str | Sequence[str],
    k: int = 21,
    metric: str = "euclidean",
    p: float = 2.0,
    within: str | None = None,
    query_col: str = "query_id",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """`query_col`, `id_col`, distance and rank (1 = nearest) of the k nearest rows per query.

    `queries` defaults to the table itself and carries the same id and feature columns. A query
    that is in the table finds itself. With `within`, only rows with an equal value are searched.
    """
    check_metric(metric, p)
    group = F.col(within) if within else F.lit(0)

    def shape(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).alias("id"), group.alias("g"), as_vector(features).alias("v"))
        return out.where("g is not null") if within else out

    table = shape(points)
    asked = table if queries is None else shape(queries)
    fetched = asked.limit(max_broadcast_queries + 1).toArrow()
    fits = (
        fetched.num_rows <= max_broadcast_queries
        and fetched.column("v").nbytes <= MAX_BROADCAST_BYTES
    )
    if fits:
        near = _scan(table, fetched, asked.schema["id"].dataType, k, metric, p)
    else:
        near = _tiles(
            table, asked, queries is None, k, metric, p, block_rows, max_pivots
        )
    return near.select(
        F.col("q").alias(query_col), F.col("id").alias(id_col), "distance", "rank"
    )


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scan(table: DataFrame, fetched: pa.Table, q_type, k, metric, p) -> DataFrame:
    id_type = table.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("q", q_type),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    q_ids = fetched.column("id").combine_chunks()
    if isinstance(q_ids, pa.ChunkedArray):
        q_ids = pa.concat_arrays(q_ids.chunks) if q_ids.num_chunks else pa.array([], q_ids.type)
    members: dict = {}
    for i, g in enumerate(fetched.column("g").to_pylist()):
        members.setdefault(g, []).append(i)
    payload = (q_ids, to_matrix(fetched.column("v")), {g: np.array(m) for g, m in members.items()})
    shared = table.sparkSession.sparkContext.broadcast(payload)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, groups = shared.value
        best, id_pa = None, None
        kth = np.full(len(matrix), np.inf)
        for b in batches:
            if not b.num_rows or not len(matrix):
                continue
            id_pa = b.column("id").type
            x, x_ids = to_matrix(b.column("v")), id_array(b.column("id"))
            if len(groups) == 1 and None not in groups:
                x_groups = np.array(b.column("g").to_pylist())
            else:
                x_groups = np.array(b.column("g").to_pylist(), dtype=object)
            parts = [best] if best is not None else []
            for g, q in groups.items():
                at = np.flatnonzero(x_groups == g)
                if not len(at):
                    continue
                rows, near, dist = nearest(matrix[q], x[at], x_ids[at], k, metric, p, kth[q])
                parts.append((q[rows], near, dist))
            if not parts:
                continue
            best = keep_top(*[np.concatenate(c) for c in zip(*parts, strict=True)], k)
            rows, _, dist = best
            full = np.bincount(rows, minlength=len(matrix)) == k
            last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True])
            last = last[full[rows[last]]]
            kth[rows[last]] = dist[last]
        if best is not None and len(best[0]):
            rows, near, dist = best
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(near.tolist(), type=id_pa), pa.array(dist)],
                names=["q", "id", "distance"],
            )

    return _ranked(table.mapInArrow(search, schema), k)


def _tiles(table, asked, self_join, k, metric, p, block_rows, max_pivots) -> DataFrame:
    # Pruning needs the triangle inequality; for cosine it runs on unit vectors, whose
    # Euclidean distance is sqrt(2 * cosine). A zero vector gets a direction of its own.
    cosine = metric == "cosine"
    space = ("euclidean", 2.0) if cosine else (metric, p)

    def place(df: DataFrame) -> DataFrame:
        if not cosine:
            return df.withColumn("u", F.col("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        unit = F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0)))
        tail = F.array(F.when(F.col("norm") > 0, 0.0).otherwise(1.0))
        return df.withColumn("norm", norm).withColumn("u", F.concat(unit, tail)).drop("norm")

    copies = Window.partitionBy("g", "v").orderBy("id")
    stored = table.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
    stored = place(stored).withColumn("first", F.col("copy") == 1).drop("copy")
    asked_once = asked.groupBy("g", "v").agg(F.min("id").alias("id"))

    n = table.count()
    pivots = choose_pivots(stored, "u", int(min(max_pivots, max(1, round(n**0.5 / 4)))))

    def metric_fn(a, b, _space=space):
        return distances(a, b, *_space)

    # Frozen: block numbers must not change if a task is run again.
    measure = _own_limit(k, metric, p, cosine) if self_join else None
    groups = group_count(n, pivots.shape[1])

    def packed(df, measure=None) -> DataFrame:
        blocks = cut_lineage(pack_blocks(df, pivots, metric_fn, block_rows, measure)).drop("block")
        # Blocks of a small cell share a group, those of a big one are spread.
        big = F.sum("n").over(Window.partitionBy("g", "cell")) > F.lit(n / groups / 4)
        block = F.monotonically_increasing_id()
        group = F.pmod(F.xxhash64("g", "cell", F.when(big, F.col("block"))), F.lit(groups))
        numbered = blocks.withColumn("block", block)
        meta = numbered.select("block", "g", "cell", "low", "high", "n", "limit")
        return numbered, cut_lineage(meta.withColumn("group", group))

    s_blocks, s_meta = packed(stored, measure)
    if self_join:
        r_blocks, r_meta = s_blocks.where(F.exists("first", lambda x: x)), s_meta
    else:
        r_blocks, r_meta = packed(place(asked_once).withColumn("first", F.lit(True)))
        cells = s_meta.groupBy("g", "cell").agg(F.max("high").alias("reach"), F.sum("n").alias("m"))
        full = F.when(F.col("m") >= k, F.col("high") + F.col("reach"))
        r_meta = r_meta.join(cells, ["g", "cell"], "left")
        r_meta = r_meta.withColumn("limit", F.coalesce(full, F.lit(float("inf"))))

    windows = _cell_windows(pivots, distances(pivots, pivots, *space), table.sparkSession)
    reach = r_meta.select(
        "g",
        F.col("block").alias("r_block"),
        F.col("group").alias("r_group"),
        "limit",
        F.explode(windows("cell", "low", "high", "limit")).alias("w"),
    ).select("g", "r_block", "r_group", "limit", "w.cell", "w.lo", "w.hi")
    s_side = s_meta.select(
        "g", "cell", "low", "high", F.col("block").alias("s_block"), F.col("group").alias("s_group")
    )
    # Per block and group to meet, the blocks to meet there.
    tiles = cut_lineage(
        reach.join(s_side, ["g", "cell"])
        .where("high >= lo and low <= hi")
        .groupBy("r_block", "r_group", "s_group", "limit")
        .agg(F.collect_list("s_block").alias("s_blocks"))
    )
    left = r_blocks.select(
        F.col("block").alias("r_block"), "ids", "v", "first", "limits"
    ).join(tiles, "r_block")
    # Renamed columns give the second side its own attributes, which cogroup needs.
    s_tiles = tiles.select(
        F.col("r_group").alias("r_key"), F.col("s_group").alias("s_key"), F.explode("s_blocks").alias("s_block")
    ).distinct()
    right = s_blocks.select(
        F.col("block").alias("s_block"), F.col("ids").alias("s_ids"), F.col("v").alias("s_v")
    ).join(s_tiles, "s_block")
    found = (
        left.groupBy("r_group", "s_group")
        .cogroup(right.groupBy("r_key", "s_key"))
        .applyInArrow(
            _group_search(k, metric, p, cosine),
            T.StructType(
                [
                    T.StructField("q", asked.schema["id"].dataType),
                    T.StructField("id", table.schema["id"].dataType),
                    T.StructField("distance", T.DoubleType()),
                ]
            ),
        )
    )
    near = _ranked(found, k).withColumnRenamed("q", "first_id")
    owners = asked.withColumnRenamed("id", "q").join(
        asked_once.withColumnRenamed("id", "first_id"), ["g", "v"]
    )
    return owners.select("q", "first_id").join(near, "first_id").drop("first_id")


def _own_limit(k, metric, p, cosine):
    """The k-th distance each asking row has inside its block, an upper bound of the true one."""

    def limits(v: np.ndarray, ids: pa.Array, first: np.ndarray) -> np.ndarray:
        if len(v) < k or not first.any():
            return np.full(int(first.sum()), np.inf)
        dist = nearest(v[first], v, id_array(ids), k, metric, p)[2].reshape(-1, k)[:, -1]
        return np.sqrt(np.maximum(0.0, 2.0 * dist)) if cosine else dist

    return limits


def _cell_windows(pivots: np.ndarray, between: np.ndarray, spark):
    """UDF: for a block and its limit, the cells that can hold closer rows and the span of
    pivot distances such rows must have."""
    shared = spark.sparkContext.broadcast(between)

    @F.pandas_udf("array<struct<cell:int,lo:double,hi:double>>")
    def windows(cell: pd.Series, low: pd.Series, high: pd.Series, limit: pd.Series) -> pd.Series:
        out = []
        for c, a, b, t in zip(cell, low, high, limit, strict=True):
            d = shared.value[c]
            slack = 1e-9 * (1.0 + d + b + (t if np.isfinite(t) else 0.0))
            near = np.maximum(0.0, np.maximum(d - b, a - d))
            far = d + b
            near[c], far[c] = a, b
            lo, hi = near - t - slack, far + t + slack
            ok = d / 2 - b <= t + slack
            ok[c] = True
            at = np.flatnonzero(ok)
            out.append(
                [{"cell": int(j), "lo": float(lo[j]), "hi": float(hi[j])} for j in at]
            )
        return pd.Series(out)

    return windows


def _group_search(k, metric, p, cosine):
    def space(x: np.ndarray) -> np.ndarray:
        if not cosine:
            return x
        norm = np.sqrt((x * x).sum(axis=1))
        return x / np.where(norm > 0, norm, 1.0)[:, None]

    def reach(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return distances(x, c) if cosine else distances(x, c, metric, p)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        others, centres, radius = [], [], []
        number = {int(b): i for i, b in enumerate(right.column("s_block").to_pylist())}
        for i in range(right.num_rows):
            b = block_matrix(right, i, "s_ids", "s_v")
            at = space(b)
            centre = at.mean(axis=0)[None, :]
            others.append((id_array(block_list(right, i, "s_ids")), b))
            centres.append(centre)
            radius.append(reach(at, centre).max())
        for i in range(left.num_rows):
            q_ids = block_list(left, i)
            asks = np.flatnonzero(block_list(left, i, "first").to_numpy(zero_copy_only=False))
            limit = np.minimum(
                block_list(left, i, "limits").to_numpy(zero_copy_only=False)[asks],
                left.column("limit")[i].as_py(),
            )
            limit = limit * (1 + 1e-9) + 1e-9
            meets = [number[int(b)] for b in left.column("s_blocks")[i].as_py()]
            if not meets or not len(asks):
                continue
            a = block_matrix(left, i)[asks]
            # Rows that cannot reach another block within their limit are not compared with it.
            gap = reach(space(a), np.concatenate([centres[j] for j in meets])) - np.array([radius[j] for j in meets])
            near = gap <= limit[:, None]
            wanted = np.flatnonzero(near.any(axis=0))
            rows = np.flatnonzero(near.any(axis=1))
            if not len(wanted) or not len(rows):
                continue
            ids = np.concatenate([others[meets[j]][0] for j in wanted])
            b = np.concatenate([others[meets[j]][1] for j in wanted])
            most = limit**2 / 2.0 if cosine else limit
            r, near_ids, dist = nearest(a[rows], b, ids, k, metric, p, most[rows])
            out.append((q_ids.take(pa.array(asks[rows][r], pa.int64())), near_ids, dist))
        s_type, q_type = right.schema.field("s_ids").type.value_type, left.schema.field("ids").type.value_type
        return pa.table(
            {
                "q": pa.chunked_array([o[0] for o in out], q_type),
                "id": pa.chunked_array([pa.array(o[1].tolist(), type=s_type) for o in out], s_type),
                "distance": pa.chunked_array([pa.array(o[2], pa.float64()) for o in out], pa.float64()),
            }
        )

    return search
