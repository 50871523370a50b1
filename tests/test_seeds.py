"""All seeds of a k-means fit go over the rows together."""

import numpy as np
from pyspark.ml.clustering import KMeans as PlainKMeans

from kinfold.operators import kmeans, lloyd


def test_seeds_share_the_readings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0.0, 4.0, 9.0)])
    df = spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>").repartition(3).persist()
    rounds, starts, sums = [], [], lloyd._sums

    def draw(**kw):
        assert kw["maxIter"] == 0
        starts.append(kw["k"])
        return PlainKMeans(**kw)

    def one_reading(data, centers):
        rounds.append(len(centers))
        return sums(data, centers)

    monkeypatch.setattr(kmeans, "KMeans", draw)
    monkeypatch.setattr(lloyd, "_sums", one_reading)
    fit = kmeans.fit_kmeans(df, "v", 3, n_init=4)
    assert rounds[0] == 4 and starts[:4] == [3] * 4
    single = []
    for s in range(42, 46):
        plain = PlainKMeans(k=3, maxIter=300, seed=s)
        vectors = df.select(kmeans.array_to_vector("v").alias("features"))
        single.append(sorted([float(a) for a in c] for c in plain.fit(vectors).clusterCenters()))
    cost = [((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2).min(axis=1).sum() for c in single]
    assert np.allclose(fit.centers, single[int(np.argmin(cost))], atol=1e-9) and abs(fit.cost - min(cost)) < 1e-6
    assert sorted(c.tolist() for c in fit.model.clusterCenters()) == fit.centers


def test_a_row_between_two_centres_counts_once(spark):
    df = spark.createDataFrame([([0.0],), ([1.0],), ([1.0],), ([2.0],)], "v array<double>")
    (count, total), = lloyd._sums(df, [np.array([[0.0], [2.0]])])
    assert count.tolist() == [3, 1] and total.ravel().tolist() == [2.0, 2.0]


def test_equal_rows_give_one_centre(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>")
    fit = kmeans.fit_kmeans(df, "v", 3, n_init=2)
    assert fit.centers == [[1.0, 2.0]] and fit.cost == 0.0


def test_sums_are_alike_with_and_without_a_shuffle(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(90, 4))
    df = spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>").repartition(5).persist()
    centers = [x[:3], x[3:8]]
    few = lloyd._sums(df, centers)
    monkeypatch.setattr(lloyd, "PART_BYTES", 0)
    for (n, s), (m, t) in zip(few, lloyd._sums(df, centers), strict=True):
        assert n.sum() == 90 and (n == m).all() and np.allclose(s, t, atol=1e-12)
