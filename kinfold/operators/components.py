"""Connected components and dense numbering, at any size without a single-task step.

A graph or list within a checked bound is settled on the driver, where it saves a dozen tiny
jobs; larger ones go through the distributed plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .clusters import small_side


SMALL_EDGES = 200_000
SMALL_ROWS = 100_000


def _small_components(edges: pa.Table) -> pa.Table:
    """The same for a fetched graph: labels sink to the smallest neighbour, then jump."""
    u, v = edges.column("u").to_pandas(), edges.column("v").to_pandas()
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # Hook the labels themselves, not only the nodes, so long chains shrink fast.
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return pa.table(
                {
                    "node": pa.array(nodes, edges.column("u").type),
                    "component": pa.array(nodes[label], edges.column("u").type),
                }
            )
        label = new


def connected_components(
    edges: DataFrame, max_rounds: int = 60, small_edges: int = SMALL_EDGES
) -> DataFrame:
    """`node`, `component` (the smallest node reachable) for edges (`a`, `b`).

    Alternating large-star / small-star rounds: every round is two map-side-combined minima
    and two joins, and the edge set ends as one star per component after a logarithmic number
    of rounds, however long its chains are.
    """
    e = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = cut_lineage(e.distinct())
    fetched = e.limit(small_edges + 1).toArrow()
    if fetched.num_rows <= small_edges:
        kind = e.schema["u"].dataType.simpleString()
        return e.sparkSession.createDataFrame(
            _small_components(fetched), f"node {kind}, component {kind}"
        )
    seen = _signature(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, larger=True)
        e = cut_lineage(_star(e, larger=False))
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(e: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours (all larger ones, or all smaller ones) on the smallest of them."""
    low = e.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = e.join(small_side(low), F.col("u") == F.col("k"))
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h)).first())


def dense_number(
    df: DataFrame, order: str, name: str, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Number rows 0, 1, ... in the order of a unique column, partition by partition."""
    fetched = df.limit(small_rows + 1).toArrow()
    if fetched.num_rows <= small_rows:
        rows = fetched.sort_by(order)
        rows = rows.append_column(name, pa.array(np.arange(rows.num_rows), pa.int32()))
        return df.sparkSession.createDataFrame(
            rows, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
        )
    parts = cut_lineage(
        df.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    )
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition, so the running sum is over a table of partitions.
    offsets = sizes.select(
        "__part",
        (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__offset"),
    )
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return (
        parts.join(F.broadcast(offsets), "__part")
        .withColumn(name, (rank + F.col("__offset")).cast("int"))
        .drop("__part", "__offset")
    )
