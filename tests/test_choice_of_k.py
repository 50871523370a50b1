"""The choice of k scores all k together, and its sums are those of plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import kmeans, lloyd, quality
from kinfold.operators.kernels import distances, euclidean_tiles

SCHEMA = "v array<double>"


def test_no_k_is_scored_by_itself(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x = np.concatenate([rng.randn(30, 2) + 6 * i for i in range(3)])
    df = spark.createDataFrame([(r,) for r in x.tolist()], SCHEMA).repartition(3)

    def refused(*args, **kw):
        raise AssertionError("the rows were read once more for one k")

    for name in ("clustering_quality", "calinski_harabasz", "davies_bouldin"):
        monkeypatch.setattr(kmeans, name, refused)
    fit, table = kmeans.tune_k(df, "v", max_k=4, n_init=2)
    rows = table.collect()
    assert fit.k == 3 and [r.k for r in rows if r.is_best] == [3] and [r.k for r in rows] == [2, 3, 4]
    got = next(r for r in rows if r.k == 3)
    labelled = kmeans.assign_nearest(df, "v", fit.centers)
    want = quality.clustering_quality(labelled, "v").first()
    assert np.allclose([got.silhouette, got.calinski_harabasz, got.davies_bouldin], list(want), atol=1e-9)


def test_equal_fits_have_equal_scores(spark):
    df = spark.createDataFrame([([float(i % 3), 0.1],) for i in range(9)], SCHEMA)
    fit, table = kmeans.tune_k(df, "v", max_k=5, n_init=2)
    rows = table.collect()
    assert fit.k == 3 and len({tuple(r[1:5]) for r in rows if r.k >= 3}) == 1
    assert rows[1].silhouette == 1.0 and rows[1].calinski_harabasz == 1.0


def test_centre_scores(spark):
    rng = np.random.RandomState(2)
    x = np.concatenate([rng.randn(60, 4), np.full((7, 4), 0.1)])
    rows = [(r.tolist(), i % 3, 0, i % 2 if i < 60 else 3) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "v array<double>, a int, b int, c int").repartition(3)
    got = quality.centre_scores(df, "v", {"a": 3, "b": 2, "c": 5})
    for name, scores in zip("abc", got, strict=True):
        want = [f(df, "v", name).first()[0] for f in (quality.calinski_harabasz, quality.davies_bouldin)]
        assert np.allclose(scores, want, rtol=1e-9)
    assert quality.centre_scores(df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), "v", {"a": 3}) is None


@pytest.mark.parametrize("step", [7, 64])
def test_tiles_have_the_distances_of_all_pairs(step):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 5)) * np.array([1e3, 1, 1, 1, 1])
    b = np.concatenate([rng.normal(size=(30, 5)), a[::3] + 1e-9, a[:4]])
    got = np.zeros((len(a), len(b)))
    for s, t, d in euclidean_tiles(a, b, step):
        got[s : s + step, t : t + step] = d
    want = distances(a, b)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[np.arange(4), -4 + np.arange(4)] == 0).all()


def test_sums_by_clusters_of_all_models():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(40, 3)), rng.normal(size=(1100, 3)), rng.integers(1, 4, 1100).astype(float)
    at = np.stack([rng.integers(0, 2, 1100), 2 + rng.integers(0, 30, 1100)], axis=1)
    d, want = distances(x, y) * w, np.zeros((40, 32))
    for j in range(32):
        want[:, j] = d[:, (at == j).any(axis=1)].sum(axis=1)
    assert np.allclose(quality._sums(x, y, w, at, 32), want, rtol=1e-12)


def test_models_in_several_runs(spark):
    """More centres than a task scores at a time, and more rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3))
    df = spark.createDataFrame([(r,) for r in x.tolist()], SCHEMA).coalesce(1).persist()
    centers = [x[a : a + 60] for a in (0, 60, 120, 180)]
    assert len(lloyd._runs([(0, 60), (60, 120), (120, 180), (180, 240)])) > 1
    for c, (n, s) in zip(centers, lloyd._sums(df, centers), strict=True):
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (n == np.bincount(own, minlength=60)).all()
        assert np.allclose(s, np.eye(60)[own].T @ x, atol=1e-9)
