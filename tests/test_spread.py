"""Choice of k on tables beyond the broadcast bound, and of few parts."""

import numpy as np

from kinfold.operators import kmeans


def test_rows_of_one_file_are_spread(spark):
    one = spark.range(1000).select("id").coalesce(1)
    assert kmeans.spread(one, 1000).rdd.getNumPartitions() == 1
    assert kmeans.spread(one, 1_000_000).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_choice_of_k_scores_all_k_at_once(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x = np.concatenate([rng.randn(40, 2) + 6 * i for i in range(3)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").coalesce(1)
    want = kmeans.tune_k(df, ["a", "b"], max_k=4, n_init=2)[1].collect()
    monkeypatch.setattr(kmeans, "MAX_BROADCAST_ROWS", 50)

    def refused(*args, **kw):
        raise AssertionError("rows met once more for one k")

    monkeypatch.setattr(kmeans, "clustering_quality", refused)
    got = kmeans.tune_k(df, ["a", "b"], max_k=4, n_init=2)[1].collect()
    assert [r.k for r in got] == [r.k for r in want] and [r.is_best for r in got] == [r.is_best for r in want]
    assert np.allclose([r[1:5] for r in got], [r[1:5] for r in want], atol=1e-9)
