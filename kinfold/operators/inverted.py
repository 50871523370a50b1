"""Approximate k nearest neighbours for any number of queries: an inverted file of k-means cells.

Every row is posted to the cell of its nearest centre; a query looks into the `probes` cells whose centres are
nearest to it and ranks their rows by the exact distance. With all cells probed the answer is exact.

The centres are fitted on a sample of at most about `sample_rows` rows (chosen by a hash of id and vector; a
parameter); every row is posted, whatever the sample. Posting lists are cut into blocks of `block_rows` rows by
range partitioning on (cell, distance, id), so that a cell of any size is spread over tasks; queries are cut the
same way by their nearest cell. Both are dealt into a few groups, and a task takes a pair of groups: a query is copied
once for each group that holds some of its cells (not for each cell), a posting block once for each group of queries that
asks for its cell. At most k candidates for a query and group come back.

Of rows with one vector only the `copies` smallest ids are posted (k of them at most can be answers), and equal
query vectors are looked up once. A row or query with a missing feature is refused, as by the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_vector
from ..session import cut_lineage
from .blocks import group_count
from .kernels import check_metric, distances, id_array, keep_top, nearest, to_matrix
from .kmeans import fit_kmeans
from .knn import knn
from .skew import salted_join

SAMPLE_ROWS = 65_536
MAX_CELLS = 16_384
BLOCK_ROWS, PROBE_ROWS = 1024, 256
COPIES = 64


@dataclass(frozen=True)
class InvertedFile:
    """Posting blocks (`cell`, `ids`, `v`) and the centres of their cells."""

    blocks: DataFrame
    centres: np.ndarray
    metric: str
    p: float
    copies: int

    @property
    def cells(self) -> int:
        return len(self.centres)

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        spark = self.blocks.sparkSession
        rows = [(i, [float(x) for x in c], self.metric, self.p, self.copies) for i, c in enumerate(self.centres)]
        kind = "cell int, centre array<double>, metric string, p double, copies int"
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        centres = np.array([r["centre"] for r in rows])
        return InvertedFile(
            spark.read.parquet(f"{path}/blocks"), centres, rows[0]["metric"], rows[0]["p"], rows[0]["copies"]
        )


def _direction(v, metric: str):
    """Where a vector lies among the centres: by direction for cosine, else as it is."""
    if metric != "cosine":
        return v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def _nearest_cells(centres, probes: int):
    """UDF: the `probes` nearest centres of a vector with their distances, nearest first."""

    @F.arrow_udf("array<struct<cell:int,far:double>>")
    def cells(u: pa.Array) -> pa.Array:
        x, c = to_matrix(u), centres.value
        cell = np.empty((len(x), probes), dtype=np.int32)
        far = np.empty((len(x), probes))
        for s in range(0, len(x), 1024):
            d = distances(x[s : s + 1024], c)
            order = np.argsort(d, axis=1, kind="stable")[:, :probes]
            cell[s : s + 1024], far[s : s + 1024] = order, np.take_along_axis(d, order, axis=1)
        flat = pa.StructArray.from_arrays([pa.array(cell.ravel()), pa.array(far.ravel())], ["cell", "far"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * probes), flat)

    return cells


def _probed(centres, probes: int):
    """UDF: the nearest centre of a vector, and the `probes` nearest as bits (one for each cell)."""

    @F.arrow_udf("struct<cell:int,bits:binary>")
    def cells(u: pa.Array) -> pa.Array:
        x, c = to_matrix(u), centres.value
        cell, bits = np.empty(len(x), dtype=np.int32), []
        for s in range(0, len(x), 1024):
            order = np.argsort(distances(x[s : s + 1024], c), axis=1, kind="stable")[:, :probes]
            cell[s : s + 1024] = order[:, 0]
            asked = np.zeros((len(order), len(c)), dtype=bool)
            np.put_along_axis(asked, order, True, axis=1)
            bits += [row.tobytes() for row in np.packbits(asked, axis=1)]
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(bits, pa.binary())], ["cell", "bits"])

    return cells


def _any_bit(cells: int):
    """UDF: the cells that any query of a block asks for."""

    @F.arrow_udf("array<int>")
    def asked(bits: pa.Array) -> pa.Array:
        found = []
        for block in bits:
            rows = np.array([np.frombuffer(b, np.uint8) for b in block.as_py()])
            found.append(np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), count=cells)))
        return pa.array(found, pa.list_(pa.int32()))

    return asked


def _group(groups: int, rows: float):
    """The group of a block: the blocks of a cell share one, but a cell of more than `rows` rows is spread."""
    big = F.sum(F.size("ids")).over(Window.partitionBy("cell")) > F.lit(rows)
    return F.pmod(F.xxhash64("cell", F.when(big, F.get("ids", F.lit(0)))), F.lit(groups))


def _blocks(df: DataFrame, keys: Sequence[str], rows: int, more: Sequence[str] = ()) -> DataFrame:
    """Runs of at most `rows` neighbours of one cell, as one row each: `cell`, `ids`, `v` and lists of `more`."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("cell", "id", "v", *more)
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("ids", T.ArrayType(df.schema["id"].dataType)),
            T.StructField("v", T.ArrayType(vector)),
            *[T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in more],
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            runs = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            starts = np.concatenate([np.arange(s, e, rows) for s, e in zip(runs[:-1], runs[1:], strict=True)])
            at = pa.array(np.r_[starts, len(cell)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, b.column(c)) for c in ("id", "v", *more)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), *lists], names=schema.names)

    return ordered.mapInArrow(cut, schema)


def build_inverted(
    points: DataFrame,
    *,
    id_col: str,
    features: str | Sequence[str],
    cells: int | None = None,
    metric: str = "euclidean",
    p: float = 2.0,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
    copies: int = COPIES,
    seed: int = 42,
) -> InvertedFile:
    """Fit the centres on a sample and post every row. `cells` defaults to the square root of the row count."""
    check_metric(metric, p)
    table = points.select(F.col(id_col).alias("id"), as_vector(features).alias("v"))
    n = table.count()
    if not n:
        raise ValueError("There are no rows to index")
    cells = max(1, min(MAX_CELLS, round(n**0.5) if cells is None else cells))
    placed = table.withColumn("u", _direction(F.col("v"), metric))
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample_rows / n)) + 1)
    sample = placed.where(part) if n > sample_rows else placed
    centres = np.array(fit_kmeans(sample, "u", cells, n_init=1, max_iter=20, seed=seed).centers)
    shared = points.sparkSession.sparkContext.broadcast(centres)
    # The limit is applied before the shuffle too, so a vector that many rows share stays small.
    once = Window.partitionBy("v").orderBy("id")
    posted = placed.withColumn("copy", F.row_number().over(once)).where(F.col("copy") <= copies)
    near = posted.withColumn("c", F.get(_nearest_cells(shared, 1)("u"), F.lit(0)))
    blocks = _blocks(near.select("id", "v", "c.cell", "c.far"), ["cell", "far", "id"], block_rows)
    return InvertedFile(cut_lineage(blocks), centres, metric, p, copies)


def knn_inverted(
    index: InvertedFile,
    queries: DataFrame,
    *,
    id_col: str,
    features: str | Sequence[str],
    k: int = 21,
    probes: int = 8,
    query_col: str = "query_id",
    probe_rows: int = PROBE_ROWS,
) -> DataFrame:
    """`query_col`, `id_col`, distance and rank of the k nearest rows found in the `probes` nearest cells."""
    if k > index.copies:
        raise ValueError(f"k ({k}) must not exceed the copies the index holds of a vector ({index.copies})")
    probes = max(1, min(probes, index.cells))
    spark = queries.sparkSession
    asked = queries.select(F.col(id_col).alias("q"), as_vector(features).alias("v"))
    once = cut_lineage(asked.groupBy("v").agg(F.min("q").alias("id")))
    shared = spark.sparkContext.broadcast(index.centres)
    looks = once.withColumn("c", _probed(shared, probes)(_direction(F.col("v"), index.metric)))
    looks = looks.select("id", "v", "c.cell", "c.bits")
    looks = cut_lineage(_blocks(looks, ["cell", "id"], probe_rows, ["bits"]))
    # Frozen above: the numbers of the blocks stay as they are.
    looks = looks.withColumn("look", F.monotonically_increasing_id())
    width = index.centres.shape[1]
    sizes = [df.agg(F.sum(F.size("ids"))).first()[0] or 0 for df in (looks, index.blocks)]
    q_groups, groups = (group_count(n, width) for n in sizes)
    look_group = _group(q_groups, sizes[0] / q_groups / 4)
    post_group = _group(groups, sizes[1] / groups / 4)
    homes = index.blocks.select("cell", "ids").withColumn("group", post_group).select("cell", "group").distinct()
    wants = cut_lineage(
        looks.withColumn("q_group", look_group)
        .select("look", "q_group", F.explode(_any_bit(index.cells)("bits")).alias("cell"))
        .join(homes, "cell")
    )
    met = wants.select("look", "q_group", "group").distinct()
    left = looks.select("look", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), "bits").join(met, "look")
    asking = wants.select(F.col("q_group").alias("q_key"), "cell").distinct()
    posted = index.blocks.withColumn("key", post_group).select("cell", "key", "ids", "v").join(asking, "cell")
    metric, p = index.metric, index.p
    id_type = index.blocks.schema["ids"].dataType.elementType
    q_type = asked.schema["q"].dataType
    schema = T.StructType(
        [
            T.StructField("q", q_type),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out, lists = [], {}
        for i, cell in enumerate(right.column("cell").to_pylist()):
            lists.setdefault(cell, []).append(i)
        lists = {
            cell: (
                np.concatenate([id_array(right.column("ids")[i].values) for i in at]),
                np.concatenate([to_matrix(right.column("v")[i].values) for i in at]),
            )
            for cell, at in lists.items()
        }
        for i in range(left.num_rows if lists else 0):
            q_ids, q = left.column("q_ids")[i].values, to_matrix(left.column("q_v")[i].values)
            bits = np.array([np.frombuffer(b, np.uint8) for b in left.column("bits")[i].as_py()])
            # Cells that the same queries ask for are searched at once.
            together: dict = {}
            for cell in lists:
                mask = (bits[:, cell // 8] >> (7 - cell % 8)) & 1
                together.setdefault(mask.tobytes(), []).append(cell)
            best, most = None, np.full(len(q), np.inf)
            for mask, cells in together.items():
                rows = np.flatnonzero(np.frombuffer(mask, np.uint8))
                if not len(rows):
                    continue
                ids, v = (np.concatenate([lists[c][j] for c in cells]) for j in (0, 1))
                r, found, dist = nearest(q[rows], v, ids, k, metric, p, most[rows])
                new = rows[r], found, dist
                best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new, strict=True))
                best = keep_top(*best, k)
                full = np.bincount(best[0], minlength=len(q)) == k
                last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True]) if len(best[0]) else np.array([], int)
                last = last[full[best[0][last]]]
                most[best[0][last]] = best[2][last]
            if best is not None:
                out.append((q_ids.take(pa.array(best[0], pa.int64())), pa.array(best[1].tolist(), type=id_type_pa(right)), best[2]))
        return pa.table(
            {
                "q": pa.chunked_array([o[0] for o in out], left.schema.field("q_ids").type.value_type),
                "id": pa.chunked_array([o[1] for o in out], id_type_pa(right)),
                "distance": pa.chunked_array([pa.array(o[2], pa.float64()) for o in out], pa.float64()),
            }
        )

    def id_type_pa(right: pa.Table) -> pa.DataType:
        return right.schema.field("ids").type.value_type

    ranks = Window.partitionBy("first_id").orderBy("distance", "id")
    near = (
        left.groupBy("q_group", "group")
        .cogroup(posted.groupBy("q_key", "key"))
        .applyInArrow(search, schema)
        .withColumnRenamed("q", "first_id")
        .withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
    )
    owners = salted_join(asked, once.withColumnRenamed("id", "first_id"), "v").select("q", "first_id")
    return salted_join(owners, cut_lineage(near), "first_id").select(
        F.col("q").alias(query_col), F.col("id").alias(id_col), "distance", "rank"
    )


def choose_probes(
    index: InvertedFile,
    points: DataFrame,
    *,
    id_col: str,
    features: str | Sequence[str],
    k: int = 21,
    recall: float = 0.95,
    sample: int = 64,
) -> int:
    """The fewest probes with which `sample` rows (in hash order) find `recall` of their exact k neighbours.

    The rows' neighbours come from the exact search; a neighbour is found if its cell is among the cells probed.
    At most `sample` * k pairs of vectors are fetched.
    """
    table = points.select(F.col(id_col).alias("id"), as_vector(features).alias("v"))
    asked = cut_lineage(table.orderBy(F.xxhash64("id"), "id").limit(sample))
    near = knn(table, asked, id_col="id", features="v", k=k, metric=index.metric, p=index.p)
    ends = near.select("query_id", "id").join(table, "id").withColumn("u", _direction(F.col("v"), index.metric))
    own = asked.select(F.col("id").alias("query_id"), _direction(F.col("v"), index.metric).alias("q"))
    pairs = ends.join(F.broadcast(own), "query_id").select("q", "u").toArrow()
    if not pairs.num_rows:
        return 1
    from_q = distances(to_matrix(pairs.column("q")), index.centres)
    cell = distances(to_matrix(pairs.column("u")), index.centres).argmin(axis=1)
    place = np.argsort(np.argsort(from_q, axis=1, kind="stable"), axis=1)[np.arange(len(cell)), cell]
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
