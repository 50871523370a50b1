"""Many k-means models at once against NumPy, and against fitting each of them alone."""

import numpy as np
import pytest

from kinfold.operators import lloyd

SCHEMA = "v array<double>"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1.0, (150, 3)) for c in (0.0, 6.0, 12.0, 30.0)])
    return x, spark.createDataFrame([(r,) for r in x.tolist()], SCHEMA).repartition(4).persist()


def squared(x, c):
    return ((x[:, None] - np.asarray(c)[None]) ** 2).sum(axis=2)


def settle(x, c, tol=lloyd.TOL):
    """Plain Lloyd rounds from given centres."""
    while True:
        own = squared(x, c).argmin(axis=1)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        shift = np.sqrt(((new - c) ** 2).sum(axis=1)).max()
        c = new
        if shift <= tol:
            return c


def test_many_models_equal_single_ones_and_numpy(blobs):
    x, df = blobs
    models = [(k, s) for k in (1, 2, 4, 7) for s in (1, 2)]
    together = lloyd.fit_many(df, "v", models)
    assert [(f.k, f.seed) for f in together] == models
    starts = lloyd._starts(df, [1, 2], 7)
    for f in together:
        want = settle(x, starts[f.seed][: f.k])
        assert np.allclose(f.centers, sorted(want.tolist()), atol=1e-9)
        assert np.isclose(f.cost, squared(x, want).min(axis=1).sum())
        alone = lloyd.fit_many(df, "v", [(f.k, f.seed)])[0]
        assert np.allclose(alone.centers, f.centers) and alone.iterations == f.iterations
    assert min(f.cost for f in together if f.k == 4) < 4 * 150 * 3


def test_starts_are_rows_and_spread(blobs):
    x, df = blobs
    rows = {tuple(r) for r in x}
    for drawn in lloyd._starts(df, [1, 2, 3], 40).values():
        assert len(drawn) == 40 == len({tuple(r) for r in drawn}) and {tuple(r) for r in drawn} <= rows
    far = lloyd._starts(df, list(range(30)), 2)
    gap = [np.sqrt(((c[0] - c[1]) ** 2).sum()) for c in far.values()]
    assert np.mean([g > 5 for g in gap]) > 0.9  # the second start lies in another group


def test_missing_copies_and_empty(spark):
    nan = float("nan")
    rows = [([1.0, 1.0],)] * 50 + [([5.0, 5.0],), (None,), ([nan, 1.0],), ([None, 1.0],)]
    fit = lloyd.fit_many(spark.createDataFrame(rows, SCHEMA), "v", [(5, 0), (1, 0)])
    assert fit[0].centers == [[1.0, 1.0], [5.0, 5.0]] and fit[0].cost == 0.0
    assert np.allclose(fit[1].centers, [[55 / 51, 55 / 51]])
    assert lloyd.fit_many(spark.createDataFrame([], SCHEMA), "v", []) == []
    with pytest.raises(ValueError, match="no rows"):
        lloyd.fit_many(spark.createDataFrame([(None,)], SCHEMA), "v", [(2, 0)])


def test_a_round_reads_the_rows_once(blobs, monkeypatch):
    x, df = blobs
    passes = []
    monkeypatch.setattr(lloyd, "_sums", lambda data, c, old=lloyd._sums: passes.append(len(c)) or old(data, c))
    fits = lloyd.fit_many(df, "v", [(k, s) for k in range(2, 8) for s in range(3)])
    assert len(passes) == max(f.iterations for f in fits) and passes[0] == 18
    assert sum(passes) == sum(f.iterations for f in fits)
