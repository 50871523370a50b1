"""DBSCAN by halo cells against brute force."""

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from kinfold.operators import halo
from kinfold.operators.dbscan import core_points, dbscan
from kinfold.operators.halo import _forest, halo_core_points, halo_dbscan

from test_clustering import _dbscan


def _rows(d, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate(
        [
            rng.normal(0, 0.3, (150, d)),
            rng.normal(2, 0.2, (100, d)),
            rng.uniform(-3, 4, (80, d)),
            np.repeat(rng.normal(1, 0.1, (2, d)), 40, 0),
            5 + rng.uniform(0, 0.01, (90, d)),  # wholly within eps: no distances needed
            np.linspace(-4, -2, 40)[:, None] + np.zeros(d),  # a chain through many cells
        ]
    ).round(4)


@pytest.mark.parametrize(
    "d,eps,m,plan",
    [
        (2, 0.15, 5, {"cells": 12, "block_rows": 16}),
        (5, 0.6, 5, {"cells": 20, "block_rows": 8}),
        (9, 1.0, 8, {"cells": 7, "block_rows": 32}),
        (9, 1.0, 8, {"cells": 1}),
    ],
)
def test_halo_matches_brute_force(spark, d, eps, m, plan):
    x = _rows(d)
    names = [f"f{i}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=names).assign(id=np.arange(len(x)))
    core, lab = _dbscan(x, eps, m)
    assert 0 < core.sum() < len(x) and lab.max() > 0 and (lab == -1).any()
    df = spark.createDataFrame(pdf).repartition(5)
    out = halo_dbscan(df, "id", names, eps, m, **plan).toPandas()
    assert (out.sort_values("id").cluster.values == lab).all()
    flags = halo_core_points(df, "id", names, eps, m, **plan).toPandas()
    assert (flags.sort_values("id").is_core.values == core).all()


def test_halo_missing_features_text_ids_and_signs_of_zero(spark):
    names = ["a", "b", "c", "d"]
    near = [(f"r{i}", 0.0 if i % 2 else -0.0, 0.01 * i, 1.0, 2.0) for i in range(6)]
    odd = [("x", None, 0.0, 1.0, 2.0), ("y", float("nan"), 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(near + odd, "id string, a double, b double, c double, d double")
    out = {r.id: r.cluster for r in dbscan(df, "id", names, 0.1, 5).collect()}
    assert out == {f"r{i}": 0 for i in range(6)} | {"x": -1, "y": -1}
    flags = {r.id: r.is_core for r in core_points(df, "id", names, 0.1, 5).collect()}
    assert flags == {f"r{i}": True for i in range(6)} | {"x": False, "y": False}


def test_halo_empty_table_and_bad_settings(spark):
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([], "id long, a double, b double, c double, d double")
    assert dbscan(df, "id", names).count() == 0
    with pytest.raises(ValueError):
        halo_dbscan(df, "id", names, eps=0)


def test_halo_hot_vector_and_vector_column(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 10 < 8, F.array(*[F.lit(1.0)] * 6)).otherwise(
            F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (i * F.col("id") * 37 % 1009) / 10.0)
        ).alias("v")
    )
    out = {r.id: r.cluster for r in halo_dbscan(df, "id", "v", 0.5, 50).collect()}
    assert len(out) == 2000 and all((c == 0) == (i % 10 < 8) for i, c in out.items())


@pytest.mark.parametrize("share", [0.0, 0.002, 0.02, 1.0])
def test_forest_joins_what_is_linked(share):
    rng = np.random.default_rng(3)
    near = rng.random((60, 45)) < share
    root, node = _forest(near)
    assert len(node) <= 104 and len(set(node.tolist())) == len(node)

    def groups(a, b):
        of = list(range(105))
        for i, j in zip(a, b, strict=True):
            x, y = of[i], of[j]
            of = [x if o == y else o for o in of]
        return {frozenset(k for k in range(105) if of[k] == o) for o in of}

    r, c = np.nonzero(near)
    assert groups(root, node) == groups(r, c + 60)


def test_screened_distances_decide_as_plain_ones():
    rng = np.random.RandomState(3)
    # On a lattice many distances are eps itself; an offset, great and infinite values leave the product no digits.
    lattice = rng.randint(0, 4, (300, 9)) * 0.1
    for a in (lattice, lattice + 1e9, lattice * 1e200, lattice * 1e-161, np.where(lattice > 0.25, np.inf, lattice), rng.rand(300, 9)):
        for eps2 in (0.04, 0.5, 0.30000000000000004, 4e-324):
            with np.errstate(all="ignore"):
                want = halo._squares(a, a[:70]) <= eps2
                assert (halo._near(a, a[:70], eps2) == want).all()
    assert halo._near(lattice[:0], lattice, 1.0).shape == (0, 300)


def test_most_distances_are_not_computed_feature_by_feature(monkeypatch):
    monkeypatch.setattr(halo, "_squares", None)
    points = np.random.RandomState(4).rand(200, 9)
    assert halo._near(points, points, 0.5).diagonal().all()
