"""K-means for many (k, seed) models at once: every pass over the rows advances all of them.

Starts: rows drawn one after the other with a chance in proportion to the squared distance from those drawn
before (k-means++), as a race: a row's time is an exponential number over its weight, and the earliest rows
win. Winners of parts are merged without knowing the total weight, so a draw is one pass. A seed's starts for
k are the first k of its list, so that all k share the passes. Up to 16 starts are drawn singly, then an
eighth more at a time, independent of k.

A Lloyd pass sends all centres to the tasks, which return a count and a sum of vectors per centre (no row
leaves its task); models whose centres move by no more than `tol` drop out. A last pass gives all costs.
The driver holds centres only: the sum of all k times the dimensions.

Defined results: rows with a missing feature (null vector, null or NaN inside) are left out; with fewer
distinct rows than k a model has that many centres; a centre that loses all its rows stays where it is; no
rows raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_vector
from .kernels import CHUNK, to_matrix

SINGLE_DRAWS = 16
# Sums of centres, of all parts of the table, that the driver takes in one round.
PART_BYTES = 64 << 20
# Rows whose distances to all centres are worked out at a time, at most.
CHUNK_ROWS = 2048
# Rows and (row, centre) scores of a round that a task has at hand at a time, so that they stay in a processor's cache.
ROUND_ROWS = 256
SCORES = 1 << 15
TOL = 1e-4


@dataclass(frozen=True)
class LloydFit:
    k: int
    seed: int
    centers: list[list[float]]
    cost: float
    iterations: int


def fit_many(
    df: DataFrame,
    features: str | Sequence[str],
    models: Sequence[tuple[int, int]],
    max_iter: int = 300,
    tol: float = TOL,
) -> list[LloydFit]:
    """A fit for each (k, seed), in the order given."""
    if not models:
        return []
    v = as_vector(features)
    data = df.select(v.alias("v")).where("v is not null")
    data = data.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        begin = _starts(data, sorted({s for _, s in models}), max(k for k, _ in models))
        centers, rounds, costs = advance(data, [begin[s][:k].copy() for k, s in models], max_iter, tol)
    finally:
        data.unpersist()
    return [
        LloydFit(k, s, sorted(c.tolist()), cost, n)
        for (k, s), c, cost, n in zip(models, centers, costs, rounds, strict=True)
    ]


def advance(
    data: DataFrame, centers: Sequence[np.ndarray], max_iter: int = 300, tol: float = TOL
) -> tuple[list[np.ndarray], list[int], list[float]]:
    """Lloyd rounds of all models from the centres given: the settled centres, rounds and costs.

    `data` has one column of vectors without missing values, and is read once a round.
    """
    centers, rounds = list(centers), [0] * len(centers)
    active = list(range(len(centers))) if max_iter > 0 else []
    data = data.select(_as_bytes(data.columns[0]).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while active:
            found = _sums(data, [centers[m] for m in active])
            moving = []
            for m, (count, total) in zip(active, found, strict=True):
                new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers[m])
                shift = np.sqrt(((new - centers[m]) ** 2).sum(axis=1)).max()
                centers[m], rounds[m] = new, rounds[m] + 1
                if shift > tol and rounds[m] < max_iter:
                    moving.append(m)
            active = moving
        return centers, rounds, _costs(data, centers)
    finally:
        data.unpersist()


def _as_bytes(vector: str) -> Column:
    """A vector as its 64-bit floats in a row, which Spark moves as one value and not number by number."""

    @F.arrow_udf("binary")
    def packed(v: pa.Array) -> pa.Array:
        x = np.ascontiguousarray(to_matrix(v))
        ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])

    return packed(vector)


def _as_matrix(col: pa.Array) -> np.ndarray:
    """(rows, d) of vectors, or of vectors as bytes."""
    if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        return to_matrix(col)
    ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)
    a, b = int(ends[col.offset]), int(ends[col.offset + len(col)])
    return np.frombuffer(col.buffers()[2], np.float64, (b - a) // 8, a).reshape(len(col), -1)


def _starts(data: DataFrame, seeds: list[int], k: int) -> dict[int, np.ndarray]:
    held = [np.empty((0, 0))] * len(seeds)
    step = size = 0
    while size < k:
        wanted = min(max(1, size // 8) if size >= SINGLE_DRAWS else 1, k - size)
        drawn = _draw(data, held, seeds, step, wanted)
        if not drawn:
            break
        # A list that has met all distinct rows stays as it is.
        held = [np.concatenate([h, drawn[m]]) if len(h) and m in drawn else drawn.get(m, h) for m, h in enumerate(held)]
        size, step = size + wanted, step + 1
    if not len(held[0]):
        raise ValueError("There are no rows to fit")
    return dict(zip(seeds, held, strict=True))


def _draw(data, held, seeds, step, wanted) -> dict[int, np.ndarray]:
    """`wanted` rows (or fewer) for each list of centres, in the order of their times."""
    shared = data.sparkSession.sparkContext.broadcast(held)

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, part = shared.value, TaskContext.get().partitionId()
        rngs = [np.random.default_rng([s & 0xFFFFFFFF, step, part]) for s in seeds]
        best: list = [None] * len(lists)
        for x in _chunks(batches, sum(map(len, lists)) + 1):
            for m, c in enumerate(lists):
                weight = _nearest(x, c)[1] if len(c) else np.ones(len(x))
                time = rngs[m].exponential(size=len(x))
                rows = np.flatnonzero(weight > 0)
                time = time[rows] / weight[rows]
                first = np.argsort(time, kind="stable")[:wanted]
                time, rows = time[first], x[rows[first]]
                if best[m] is not None:
                    time, rows = np.concatenate([best[m][0], time]), np.concatenate([best[m][1], rows])
                    first = np.argsort(time, kind="stable")[:wanted]
                    time, rows = time[first], rows[first]
                best[m] = time, rows
        for m, b in enumerate(best):
            if b is not None and len(b[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(b[0]), pa.int32()), pa.array(b[0]), pa.array(list(b[1]), pa.list_(pa.float64()))],
                    names=["model", "time", "v"],
                )

    order = Window.partitionBy("model").orderBy("time", "v")
    won = data.mapInArrow(race, "model int, time double, v array<double>")
    won = won.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    out: dict[int, list] = {}
    for r in won.orderBy("model", "place").collect():  # `wanted` rows a seed
        rows = out.setdefault(r["model"], [])
        if not any(r["v"] == x for x in rows):
            rows.append(r["v"])
    return {m: np.array(rows) for m, rows in out.items()}


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Rows in blocks whose distances to `width` centres stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _as_matrix(batch.column(0))
        size = max(1, min(CHUNK_ROWS, CHUNK // max(width, 1)))
        for a in range(0, len(x), size):
            yield x[a : a + size]


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its exact squared distance."""
    j = ((c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)).argmin(axis=1)
    return j, ((x - c[j]) ** 2).sum(axis=1)


def _sums(data: DataFrame, centers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, sum of rows) of every centre of every model."""
    ends = np.cumsum([len(c) for c in centers])
    shared = data.sparkSession.sparkContext.broadcast((np.concatenate(centers), ends))
    width = centers[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ends = shared.value
        norms, bounds = (c * c).sum(axis=1), list(zip(np.r_[0, ends[:-1]], ends, strict=True))
        count, total = np.zeros(len(c)), np.zeros_like(c)
        doubled = -2.0 * c
        runs = _runs(bounds)
        for block in _chunks(batches, 1):
            for x in (block[i : i + ROUND_ROWS] for i in range(0, len(block), ROUND_ROWS)):
                for run in runs:
                    low, high = run[0][0], run[-1][1]
                    score = doubled[low:high] @ x.T
                    score += norms[low:high, None]
                    own = np.empty_like(score)
                    for a, b in run:
                        part = score[a - low : b - low]
                        np.equal(part, part.min(axis=0), out=own[a - low : b - low], casting="unsafe")
                    tied = np.flatnonzero(own.sum(axis=0) != len(run))
                    for a, b in run if len(tied) else ():
                        first = a - low + own[a - low : b - low, tied].argmax(axis=0)
                        own[a - low : b - low, tied] = 0.0
                        own[first, tied] = 1.0
                    count[low:high] += own.sum(axis=1)
                    total[low:high] += own @ x
        yield from give(count, total)

    def whole(count: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        if count.any():
            yield pa.RecordBatch.from_pydict({"n": [count.tobytes()], "s": [total.tobytes()]})

    def by_centre(count: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array(count[used].astype(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), width).cast(pa.list_(pa.float64())),
                ],
                names=["centre", "n", "s"],
            )

    count, total = np.zeros(int(ends[-1])), np.zeros((int(ends[-1]), width))
    # Where the sums of all parts are few, the driver adds them up without a shuffle; else one row per centre comes back.
    if data.rdd.getNumPartitions() * int(ends[-1]) * width * 8 <= PART_BYTES:
        give = whole
        for r in data.mapInArrow(add, "n binary, s binary").toArrow().to_pylist():
            count += np.frombuffer(r["n"])
            total += np.frombuffer(r["s"]).reshape(total.shape)
    else:
        give = by_centre
        sums = [F.sum(F.get("s", F.lit(i))) for i in range(width)]
        parts = data.mapInArrow(add, "centre int, n bigint, s array<double>")
        got = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.array(*sums).alias("s")).toArrow()
        if got.num_rows:
            count[got["centre"].to_numpy()] = got["n"].to_numpy()
            total[got["centre"].to_numpy()] = to_matrix(got["s"])
    return list(zip(np.split(count, ends[:-1]), np.split(total, ends[:-1]), strict=True))


def _runs(bounds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Models one after the other, in runs of as many as `SCORES` has room for."""
    runs: list = []
    for a, b in bounds:
        if not runs or (b - runs[-1][0][0]) * ROUND_ROWS > SCORES:
            runs.append([])
        runs[-1].append((a, b))
    return runs


def _costs(data: DataFrame, centers: list[np.ndarray]) -> list[float]:
    shared = data.sparkSession.sparkContext.broadcast(centers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        total = np.zeros(len(models))
        for x in _chunks(batches, max(map(len, models))):
            for m, c in enumerate(models):
                total[m] += _nearest(x, c)[1].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(models), dtype=np.int32)), pa.array(total)], names=["model", "cost"]
        )

    parts = data.mapInArrow(add, "model int, cost double")
    rows = parts.groupBy("model").agg(F.sum("cost").alias("cost")).collect()  # one row per model
    found = {r["model"]: r["cost"] for r in rows}
    return [float(found[m]) for m in range(len(centers))]
