"""Silhouettes of several labellings in one meeting of the rows."""

import numpy as np

from kinfold.operators import quality


def test_silhouettes_of_many_labellings_at_once(spark):
    """One meeting of the rows scores all labellings, as the scores one by one."""
    rng = np.random.RandomState(2)
    x = np.concatenate([rng.randn(90, 3), np.zeros((10, 3))])
    df = spark.createDataFrame(
        [(r.tolist(), i % 3 if i < 90 else 1, 0, i if i < 90 else 7) for i, r in enumerate(x)],
        "v array<double>, a int, b int, c int",
    )
    got = quality.silhouettes(df, "v", ["a", "b", "c"], tile_rows=30)
    for name, score in zip("abc", got, strict=True):
        assert abs(score - quality.silhouette(df, "v", name).first()[0]) < 1e-9
    assert got[1] == quality.ONE_LABEL
