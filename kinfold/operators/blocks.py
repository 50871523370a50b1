"""Cutting a table of vectors into bounded blocks, so that block pairs can be worked on by
separate tasks.

Rows are sent to their nearest pivot (a bounded sample of the table) and range-partitioned
by (group, cell, distance to the pivot, id). The range cut points are sampled from the data, so a
cell with any share of the rows is spread over as many partitions as its size asks for, and
each block is a run of at most `rows` neighbouring rows: a thin shell around its pivot. A
block travels as one row.

Blocks meet in groups: each side is dealt into a few groups of about `GROUP_BYTES` of vectors, and one
task takes a pair of groups. A block is copied once for each group it has to meet, not for each block, so
what is moved is the table times the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import to_matrix

BLOCK_ROWS = 2048
MAX_PIVOTS = 1024
#: Vectors of one side that a task holds, and the least number of groups on a side (so that there are tasks enough).
GROUP_BYTES = 32 << 20
MIN_GROUPS = 8


def choose_pivots(df: DataFrame, vector: str, count: int) -> np.ndarray:
    """At most `count` distinct vectors in hash order (a bounded driver fetch by design)."""
    picked = df.orderBy(F.xxhash64(vector)).select(vector).limit(count).toArrow()
    return np.unique(to_matrix(picked.column(vector)), axis=0)


def pack_blocks(
    df: DataFrame, pivots: np.ndarray, distance, rows: int = BLOCK_ROWS, measure=None
) -> DataFrame:
    """One row per block: its group, cell, shell (`low`, `high`), ids, vectors and limits.

    `df` has `id`, `g` (rows of different groups never share a block), `v` (the vector kept), `u`
    (the vector placed among the pivots) and `first` (whether the row asks). `measure(v, ids, first)`
    gives each asking row a limit from the block's own rows; `limit` is the largest.
    """
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell:int,distance:double>")
    def nearest(u: pa.Array) -> pa.Array:
        x, p = to_matrix(u), shared.value
        cell, dist = np.empty(len(x), dtype=np.int32), np.empty(len(x))
        for s in range(0, len(x), 1024):
            d = distance(x[s : s + 1024], p)
            cell[s : s + 1024] = d.argmin(axis=1)
            dist[s : s + 1024] = d.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], ["cell", "distance"])

    placed = df.withColumn("near", nearest("u")).select(
        "id", "g", "v", "first", "near.cell", F.col("near.distance").alias("far")
    )
    keys = ["g", "cell", "far", "id"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    id_type, g_type = df.schema["id"].dataType, df.schema["g"].dataType
    schema = T.StructType(
        [
            T.StructField("g", g_type),
            T.StructField("cell", T.IntegerType()),
            T.StructField("block", id_type),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("limit", T.DoubleType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("v", T.ArrayType(T.DoubleType())),
            T.StructField("first", T.ArrayType(T.BooleanType())),
            T.StructField("limits", T.ArrayType(T.DoubleType())),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        key, parts = None, []
        closed: list = []

        def close(parts: list) -> list:
            """Turn the open run's pieces into full blocks; return what is left over."""
            ids = pa.concat_arrays([p[0] for p in parts])
            v, far, first = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            full = len(ids) - len(ids) % rows
            for s in range(0, full, rows):
                add(ids.slice(s, rows), v[s : s + rows], far[s : s + rows], first[s : s + rows])
            if full == len(ids):
                return []
            return [(ids.slice(full), v[full:], far[full:], first[full:])]

        def add(ids, v, far, first) -> None:
            limits = np.full(len(ids), np.inf)
            if measure:
                limits[first] = measure(v, ids, first)
            closed.append((*key, ids, v, far, first, limits))

        def flush(parts: list) -> None:
            for p in close(parts) if parts else ():
                add(*p)

        def emit() -> pa.RecordBatch:
            cols = list(zip(*closed, strict=True))
            cell, g, ids, v, far, first, limits = cols
            sizes = [len(i) for i in ids]
            at = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            wide = pa.array(np.r_[0, np.cumsum([x.size for x in v])], pa.int32())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(g, arrow[1]),
                    pa.array(cell, pa.int32()),
                    pa.concat_arrays([i.slice(0, 1) for i in ids]),
                    pa.array([f[0] for f in far]),
                    pa.array([f[-1] for f in far]),
                    pa.array(sizes, pa.int32()),
                    pa.array([x[f].max(initial=0.0) for x, f in zip(limits, first, strict=True)]),
                    pa.ListArray.from_arrays(at, pa.concat_arrays(ids)),
                    pa.ListArray.from_arrays(wide, pa.array(np.concatenate([x.ravel() for x in v]))),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(first))),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(limits))),
                ],
                names=schema.names,
            )
            closed.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            arrow = (b.column("id").type, b.column("g").type)
            cell, group = b.column("cell").to_numpy(), b.column("g")
            code = group.dictionary_encode().indices.to_numpy()
            new = np.r_[True, (cell[1:] != cell[:-1]) | (code[1:] != code[:-1])]
            edges = np.r_[np.flatnonzero(new), len(cell)]
            v, far = to_matrix(b.column("v")), b.column("far").to_numpy()
            first = b.column("first").to_numpy(zero_copy_only=False)
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                run = (int(cell[s]), group[int(s)].as_py())
                if run != key:
                    flush(parts)
                    key, parts = run, []
                parts.append((b.column("id").slice(s, e - s), v[s:e], far[s:e], first[s:e]))
                parts = close(parts)
            if closed:
                yield emit()
        flush(parts)
        if closed:
            yield emit()

    return ordered.mapInArrow(cut, schema)


def group_count(rows: int, width: int, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups a side of `rows` vectors of `width` numbers is dealt into."""
    return max(MIN_GROUPS, -(-rows * 8 * max(1, width) // group_bytes))


def block_list(t: pa.Table, i: int, name: str = "ids") -> pa.Array:
    return t.column(name)[i].values


def block_matrix(t: pa.Table, i: int, ids: str = "ids", v: str = "v") -> np.ndarray:
    """The vectors of the i-th block of a table."""
    flat = t.column(v)[i].values.to_numpy(zero_copy_only=False)
    return flat.reshape(len(t.column(ids)[i]), -1)
