"""Cheap screens before the exact distances."""

import numpy as np
import pytest

from kinfold.operators import kernels


@pytest.mark.parametrize("metric,p", [("manhattan", 1.0), ("minkowski", 3.0), ("minkowski", 2.5), ("euclidean", 2.0)])
@pytest.mark.parametrize("shift,size", [(0.0, 1.0), (1e4, 1.0), (0.0, 1e-6)])
def test_screens_lose_nothing(metric, p, shift, size):
    rng = np.random.RandomState(1)
    a, b = rng.randn(70, 9) * size + shift, rng.randn(4500, 9) * size + shift
    b[50:90] = a[3] = b[5]
    d = kernels.distances(a, b, metric, p)
    want = kernels.keep_top(np.repeat(np.arange(70), 4500), np.tile(np.arange(4500), 70), d.ravel(), 6)
    got = kernels.nearest(a, b, np.arange(4500), 6, metric, p)
    assert (got[0] == want[0]).all() and np.allclose(got[2], want[2], rtol=1e-9, atol=1e-12 * (1 + shift))
    bound = kernels._screen(a, b, metric, p)
    assert not isinstance(bound, kernels._Exact)  # the screen does not go through all exact distances
