"""DBSCAN in four dimensions: near cells slab by slab."""

import numpy as np

from kinfold.operators import dbscan, halo


def test_four_dimensions_go_by_the_grid(spark, monkeypatch):
    rng = np.random.RandomState(6)
    x = np.concatenate([rng.randn(150, 4) * 0.15, rng.randn(60, 4) * 0.2 + 1, rng.rand(40, 4) * 3]).round(2)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(900 + i, None, 0.0, float("nan"), 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    want = sorted(halo.halo_dbscan(df, "id", list("abcd"), 0.3, 5).select("id", "cluster").collect())

    def refused(*args, **kw):
        raise AssertionError("pairs of points")

    monkeypatch.setattr(dbscan, "halo_dbscan", refused)
    got = sorted(dbscan.dbscan(df, "id", list("abcd"), 0.3, 5).select("id", "cluster").collect())
    assert got == want and len({c for _, c in got}) > 2
