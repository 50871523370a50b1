"""The inverted file against the exact search, and joins with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import clusters, recommend, skew
from kinfold.operators.inverted import InvertedFile, build_inverted, choose_probes, knn_inverted
from kinfold.operators.knn import knn


def vectors(spark, n=3000, d=12, groups=30, seed=4):
    rng = np.random.RandomState(seed)
    centres = rng.randn(groups, d) * 3
    x = centres[rng.randint(0, groups, n)] + rng.randn(n, d)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_all_cells_are_exact(spark, metric):
    df = vectors(spark, 700)
    asked = df.where("id % 7 = 0")
    index = build_inverted(df, id_col="id", features="v", cells=12, metric=metric, block_rows=64)
    got = knn_inverted(index, asked, id_col="id", features="v", k=10, probes=12, probe_rows=16)
    want = knn(df, asked, id_col="id", features="v", k=10, metric=metric)
    assert rows_of(got) == rows_of(want)


def test_recall_and_probes(spark):
    df = vectors(spark)
    asked = df.where("id % 50 = 0")
    exact = {(r.query_id, r.id) for r in knn(df, asked, id_col="id", features="v", k=10).collect()}
    index = build_inverted(df, id_col="id", features="v", sample_rows=1000)
    assert index.blocks.select(F.explode("ids")).count() == 3000  # every row is posted
    recall = []
    for probes in (1, 8):
        got = {(r.query_id, r.id) for r in knn_inverted(index, asked, id_col="id", features="v", k=10, probes=probes).collect()}
        recall.append(len(got & exact) / len(exact))
    assert recall[0] <= recall[1] and recall[1] >= 0.9


def test_probes_are_chosen_by_recall(spark):
    # Vectors without structure need many cells.
    rng = np.random.RandomState(8)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.randn(1200, 16))], "id long, v array<double>")
    asked = df.where("id % 50 = 0")
    index = build_inverted(df, id_col="id", features="v")
    probes = choose_probes(index, df, id_col="id", features="v", k=10)
    assert 1 < probes <= index.cells
    exact = {(r.query_id, r.id) for r in knn(df, asked, id_col="id", features="v", k=10).collect()}
    got = {(r.query_id, r.id) for r in knn_inverted(index, asked, id_col="id", features="v", k=10, probes=probes).collect()}
    assert len(got & exact) / len(exact) >= 0.9


def test_hot_vector_and_store(spark, tmp_path):
    df = vectors(spark, 300)
    same = spark.range(1000, 2000).select("id", F.array(*[F.lit(0.5)] * 12).alias("v"))
    both = df.unionByName(same)
    index = build_inverted(both, id_col="id", features="v", cells=5, copies=21)
    assert index.blocks.select(F.explode("ids")).count() == 300 + 21
    index.save(str(tmp_path))
    again = InvertedFile.load(spark, str(tmp_path))
    got = knn_inverted(again, both, id_col="id", features="v", k=21, probes=5)
    assert rows_of(got) == rows_of(knn(both, id_col="id", features="v", k=21))
    with pytest.raises(ValueError, match="copies"):
        knn_inverted(again, both, id_col="id", features="v", k=22)
    with pytest.raises(ValueError, match="no rows"):
        build_inverted(both.limit(0), id_col="id", features="v")


def hot(spark, n=20_000):
    # Four rows of five under one key, some keys null, some without a match.
    key = F.when(F.col("id") % 5 < 4, F.lit(7)).when(F.col("id") % 50 == 4, None).otherwise(F.col("id") % 90)
    return spark.range(n).select("id", key.cast("long").alias("k"))


def test_heavy_keys(spark):
    found = skew.heavy_keys(hot(spark), ["k"])
    assert [round(s, 2) for s in found.values()] == [0.82]
    assert skew.heavy_keys(hot(spark).limit(0), ["k"]) == {}


@pytest.mark.parametrize("how", skew.PRESERVED)
def test_salted_join_equals_join(spark, how):
    left = hot(spark, 3000)
    right = spark.range(60).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    right = right.unionByName(right.where("k % 10 = 7"))
    got = skew.salted_join(left, right, "k", how)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_hot_key_is_shared_by_tasks(spark):
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        moods = spark.range(90).select(F.col("id").alias("cluster_id"), F.lit("m").alias("mood"))
        out = clusters.attach_moods(hot(spark), moods, "k", limit=0).withColumn("task", F.spark_partition_id())
        of_hot = out.where("k = 7").groupBy("task").count().collect()
        plain = hot(spark).join(moods.withColumnRenamed("cluster_id", "k"), "k", "left")
        plain = plain.withColumn("task", F.spark_partition_id()).where("k = 7").groupBy("task").count().collect()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert len(plain) == 1
    assert len(of_hot) >= 6 and max(r["count"] for r in of_hot) < 0.5 * sum(r["count"] for r in of_hot)


def test_unsupported_join(spark):
    with pytest.raises(ValueError, match="join"):
        skew.salted_join(hot(spark), hot(spark), "k", "full")


def test_repeated_ids(spark):
    rows = [(1, 0.0, 1), (1, 9.0, 2), (2, 0.1, 3), (2, 8.0, 4), (3, 0.3, 5), (4, 9.1, 6)]
    df = spark.createDataFrame([(i, x, n, 0) for i, x, n in rows], "id int, x double, n int, cluster int")
    with pytest.raises(ValueError, match="repeated"):
        recommend.similar(df, id_col="id", features=["x"])
    out = recommend.similar(df, id_col="id", features=["x"], n=2, row_order="n", rows=df.select("id", "n", "x"))
    got = sorted((r.query_id, r.rank, r.id, r.n) for r in out.where("query_id < 3").collect())
    assert got == [(1, 1, 2, 3), (1, 2, 3, 5), (2, 1, 1, 1), (2, 2, 3, 5)]
