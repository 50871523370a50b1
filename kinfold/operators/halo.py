"""Density clustering (DBSCAN) in many dimensions: pivot cells with a halo of copied rows.

In more than a few dimensions the neighbouring cells of a grid cannot be listed. Here the space is cut into the
cells of pivots (a bounded sample of the table), each point has its home in the cell of its nearest pivot, and is copied
into every other cell whose border (the plane half way between the two pivots) is within eps of it. So all neighbours of
a point are found inside its home cell, as members or copies:

* core: a home point counts the rows within eps of it in its cell;
* links: core points of one cell are linked there, and a core copy links its home's cluster with the cell's. A
  link across a border is looked for on one side only;
* border: a home point that is not core takes the lowest cluster number among the core points within eps.

A cell is worked on as pairs of blocks of at most `block_rows` points: thin shells around the pivot, so pairs whose
shells are more than eps apart are left out, and pairs that lie wholly within eps of each other (around the
pivot) need no distances. Counts come back as one partial sum per point and pair of blocks, links as a spanning forest of
the pair (fewer edges than points): pairs of points are never listed. Blocks of a hot cell are dealt over several tasks.

Equal rows fold into one weighted point. Where eps is large against the distances of the pivots most points are copied
into most cells, and the work becomes that of all pairs of blocks, in the same bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_vector
from ..session import cut_lineage
from .blocks import MAX_PIVOTS, choose_pivots
from .clusters import NOISE_LABEL
from .components import connected_components, dense_number
from .kernels import to_matrix
from .skew import lookup, salted_join

BLOCK_ROWS = 1024
#: Rounding of distances, as a share of them.
SLACK = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        t = np.subtract.outer(a[:, j], b[:, j])
        out += np.multiply(t, t, out=t)
    return out


def _near(a: np.ndarray, b: np.ndarray, eps2: float) -> np.ndarray:
    """`_squares(a, b) <= eps2`, by one matrix product but where its rounding leaves that open."""
    with np.errstate(over="ignore", invalid="ignore"):
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        # All sums above and below, the product included, are off by less than this in all.
        off = 16 * (a.shape[1] + 4) * np.finfo(float).eps * (aa.max(initial=0.0) + bb.max(initial=0.0))
        off += np.finfo(float).tiny
        d2 = a @ (-2.0 * b.T)
        d2 += aa[:, None]
        d2 += bb
        near = d2 < eps2 - off
        i, k = np.nonzero(~(near | (d2 > eps2 + off)))
    if 4 * len(i) > d2.size:
        return _squares(a, b) <= eps2
    if len(i):
        out = np.zeros(len(i))
        for j in range(a.shape[1]):
            t = a[i, j] - b[k, j]
            out += t * t
        near[i, k] = out <= eps2
    return near


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that join each component of a two-sided graph; nodes are rows, then columns."""
    n, m = near.shape
    none = n + m
    label = np.arange(n + m)
    while True:
        low = label.copy()
        low[n:] = np.minimum(low[n:], np.where(near, label[:n, None], none).min(axis=0))
        low[:n] = np.minimum(low[:n], np.where(near, low[None, n:], none).min(axis=1))
        new = low.copy()
        np.minimum.at(new, label, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n + m))
            return label[node], node
        label = new


class _Halo:
    """The folded points of a table, posted to their home cells and to the cells whose halo they are in."""

    def __init__(
        self,
        df: DataFrame,
        id_col: str,
        features: str | Sequence[str],
        eps: float,
        min_samples: int,
        cells: int | None,
        block_rows: int,
    ):
        if eps <= 0 or min_samples < 1:
            raise ValueError("eps must be positive and min_samples at least 1")
        self.eps, self.eps2, self.min_samples = float(eps), float(eps) ** 2, int(min_samples)
        self.block_rows = block_rows
        # Adding 0.0 turns -0.0 into 0.0, which are equal but would group apart.
        vector = F.transform(as_vector(features), lambda x: x.cast("double") + F.lit(0.0))
        self.rows = df.select(F.col(id_col).alias("id"), vector.alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
        self.points = cut_lineage(
            self.rows.where(whole)
            .groupBy("v")
            .agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))
            .withColumnRenamed("pid", "id")
        )
        self.id_type = self.points.schema["id"].dataType
        n = self.points.count()
        count = max(1, min(MAX_PIVOTS, round(n**0.5 / 4) if cells is None else cells))
        pivots = choose_pivots(self.points, "v", count) if n else np.zeros((1, 1))
        posted = self.points.withColumn("p", F.explode(self._posts(pivots)("v")))
        self.posted = cut_lineage(posted.select("id", "w", "v", "p.cell", "p.home", "p.far"))

    def _posts(self, pivots: np.ndarray):
        """UDF: the cells a point is posted to, its home, and its distance from each cell's pivot."""
        shared = self.points.sparkSession.sparkContext.broadcast(pivots)
        eps = self.eps

        @F.arrow_udf("array<struct<cell:int,home:int,far:double>>")
        def posts(v: pa.Array) -> pa.Array:
            x, c = to_matrix(v), shared.value
            between = np.sqrt(_squares(c, c))
            row, cell, home, far = [], [], [], []
            for s in range(0, max(1, len(x)), 1024):
                d2 = _squares(x[s : s + 1024], c)
                own = d2.argmin(axis=1)
                least = np.take_along_axis(d2, own[:, None], axis=1)
                # Distance to the plane half way to another pivot: (d2 - least) / (2 * between).
                reach = (eps * 2 * between[own]) * (1 + SLACK) + SLACK * d2
                r, k = np.nonzero(d2 - least <= reach)
                row.append(r + s)
                cell.append(k)
                home.append(own[r])
                far.append(np.sqrt(d2[r, k]))
            at = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(row), minlength=len(x)))])
            flat = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(cell).astype(np.int32)),
                    pa.array(np.concatenate(home).astype(np.int32)),
                    pa.array(np.concatenate(far)),
                ],
                ["cell", "home", "far"],
            )
            return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)

        return posts

    def blocks(self, posted: DataFrame, value: str) -> DataFrame:
        """Runs of at most `block_rows` points of one cell, ordered by their distance from its pivot, as one row
        each: `cell`, the shell (`low`, `high`), `ids`, `v` and a number of each point (`value`)."""
        keys, rows = ["cell", "far", "id"], self.block_rows
        ordered = posted.repartitionByRange(*keys).sortWithinPartitions(*keys)
        ordered = ordered.select("cell", "far", "id", "v", F.col(value).cast("long").alias("value"))
        schema = T.StructType(
            [
                T.StructField("cell", T.IntegerType()),
                T.StructField("low", T.DoubleType()),
                T.StructField("high", T.DoubleType()),
                T.StructField("ids", T.ArrayType(self.id_type)),
                T.StructField("v", T.ArrayType(T.ArrayType(T.DoubleType()))),
                T.StructField("value", T.ArrayType(T.LongType())),
            ]
        )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
                runs = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
                starts = np.concatenate([np.arange(s, e, rows) for s, e in zip(runs[:-1], runs[1:], strict=True)])
                ends = np.r_[starts[1:], len(cell)]
                at = pa.array(np.r_[starts, len(cell)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, b.column(c)) for c in ("id", "v", "value")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[starts]), pa.array(far[starts]), pa.array(far[ends - 1]), *lists],
                    names=schema.names,
                )

        return cut_lineage(ordered.mapInArrow(cut, schema))

    def meet(self, left: DataFrame, right: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
        """`work(left ids, right ids, left values, right values, near)` for the pairs of blocks of each cell that
        may hold points within eps of each other; `near` tells which are."""
        other = right.select("cell", *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "cell"])
        limit = self.eps * (1 + SLACK)
        # The shells' bounds are distances from one pivot, rounded.
        near_shells = (F.col("low") - F.col("b_high") <= limit + SLACK * F.col("low")) & (
            F.col("b_low") - F.col("high") <= limit + SLACK * F.col("b_low")
        )
        pairs = salted_join(left, other, "cell").where(near_shells)
        pairs = pairs.select("high", "ids", "v", "value", "b_high", "b_ids", "b_v", "b_value")
        eps, eps2 = self.eps, self.eps2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    one = {c: cols[c][i] for c in cols}
                    ids, b_ids = one["ids"].values, one["b_ids"].values
                    if one["high"].as_py() + one["b_high"].as_py() <= eps * (1 - SLACK):
                        near = None
                    else:
                        near = _near(to_matrix(one["v"].values), to_matrix(one["b_v"].values), eps2)
                        if not near.any():
                            continue
                    values = (one[c].values.to_numpy() for c in ("value", "b_value"))
                    yield from work(ids, b_ids, *values, near)

        return pairs.mapInArrow(run, schema)

    def core(self) -> DataFrame:
        """`id` of the points with at least `min_samples` rows within eps, themselves included."""
        home = self.blocks(self.posted.where("cell = home"), "w")
        copies = self.blocks(self.posted.where("cell <> home"), "w")
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("n", T.LongType())])

        def count(ids, b_ids, w, b_w, near):
            n = np.full(len(ids), b_w.sum()) if near is None else near @ b_w
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(n[some])], names=schema.names)

        counts = self.meet(home, home.unionByName(copies), count, schema)
        around = counts.groupBy("id").agg(F.sum("n").alias("n"))
        return cut_lineage(around.where(F.col("n") >= self.min_samples).select("id"))

    def links(self, core: DataFrame) -> DataFrame:
        """Edges (`a`, `b`) between core points within eps of each other that join what belongs together."""
        posted = self.posted.join(core, "id", "left_semi")
        home = self.blocks(posted.where("cell = home"), "w")
        copies = self.blocks(posted.where("home < cell"), "w")
        schema = T.StructType([T.StructField("a", self.id_type), T.StructField("b", self.id_type)])

        def link(ids, b_ids, w, b_w, near):
            nodes = pa.concat_arrays([ids, b_ids])
            if near is None:
                root, node = np.zeros(len(nodes) - 1, np.int64), np.arange(1, len(nodes))
            else:
                root, node = _forest(near)
            yield pa.RecordBatch.from_arrays(
                [nodes.take(pa.array(root)), nodes.take(pa.array(node))], names=schema.names
            )

        return self.meet(home, home.unionByName(copies), link, schema).where("a <> b")

    def border(self, core: DataFrame, labels: DataFrame) -> DataFrame:
        """`id` and the lowest label within eps, for points that are not core."""
        rest = self.posted.where("cell = home").join(core, "id", "left_anti")
        asking = self.blocks(rest, "w")
        known = self.blocks(self.posted.join(labels, "id"), "label")
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("label", T.LongType())])

        def lowest(ids, b_ids, w, b_label, near):
            if near is None:
                near = np.ones((len(ids), len(b_ids)), dtype=bool)
            some = np.flatnonzero(near.any(axis=1))
            low = np.where(near[some], b_label, np.iinfo(np.int64).max).min(axis=1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(low)], names=schema.names)

        return self.meet(asking, known, lowest, schema).groupBy("id").agg(F.min("label").alias("label"))

    def back_to_rows(self, found: DataFrame) -> DataFrame:
        """Give every row what its point got; a vector that many rows share is dealt over tasks."""
        by_vector = self.points.select("id", "v").join(found, "id").drop("id")
        return salted_join(self.rows, by_vector, "v", "left").drop("v")


def halo_core_points(
    df: DataFrame,
    id_col: str,
    features: str | Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`id_col`, `is_core`: whether at least `min_samples` rows (itself included) are within eps.

    A row with a missing feature (NULL or NaN) has no neighbours and is not core.
    """
    halo = _Halo(df, id_col, features, eps, min_samples, cells, block_rows)
    rows = halo.back_to_rows(halo.core().withColumn("is_core", F.lit(True)))
    return rows.select(F.col("id").alias(id_col), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def halo_dbscan(
    df: DataFrame,
    id_col: str,
    features: str | Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    cluster: str = "cluster",
    cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The table with a cluster label per row, numbered by first core row; -1 for noise.

    A row with a missing feature (NULL or NaN) is noise.
    """
    halo = _Halo(df, id_col, features, eps, min_samples, cells, block_rows)
    core = halo.core()
    linked = connected_components(halo.links(core))
    joined = core.join(linked, F.col("id") == F.col("node"), "left")
    # A core point that reaches no other is a component of its own.
    joined = cut_lineage(joined.select("id", F.coalesce("component", "id").alias("component")))
    numbers = dense_number(joined.select("component").distinct(), "component", "label")
    labels = cut_lineage(
        lookup(joined, numbers.select("component", "label"), "component").select(
            "id", F.col("label").cast("long").alias("label")
        )
    )
    rows = halo.back_to_rows(labels.unionByName(halo.border(core, labels)))
    out = rows.select(
        F.col("id").alias(id_col), F.coalesce("label", F.lit(NOISE_LABEL)).cast("int").alias(cluster)
    )
    return df.drop(cluster).join(out, id_col)
