"""Blocks that meet in groups: a block is copied once for each group, not for each block."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.operators import recommend
from kinfold.operators.blocks import MIN_GROUPS, group_count
from kinfold.operators.inverted import build_inverted, knn_inverted
from kinfold.operators.knn import knn


def _vectors(spark, n=400, d=6):
    x = np.random.RandomState(3).randn(n, d)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def _keys_of_meeting(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return next(line for line in plan.splitlines() if "CoGroups" in line)


def test_group_count():
    assert group_count(100, 64) == MIN_GROUPS
    assert group_count(600_000, 64) == 10  # each row copied ten times a side, whatever the blocks
    assert group_count(600_000, 640) == 92


def test_blocks_meet_in_groups(spark):
    """A block is sent once to each group of blocks, not once to each block."""
    df = _vectors(spark)
    near = knn(df, id_col="id", features="v", k=4, max_broadcast_queries=0, block_rows=8, max_pivots=4)
    assert "r_group" in _keys_of_meeting(near)
    want = knn(df, id_col="id", features="v", k=4)
    assert sorted(near.select("query_id", "rank", "id").collect()) == sorted(want.select("query_id", "rank", "id").collect())


def test_probes_meet_in_groups(spark):
    df = _vectors(spark)
    index = build_inverted(df, id_col="id", features="v", cells=20, block_rows=8)
    near = knn_inverted(index, df, id_col="id", features="v", k=4, probes=20, probe_rows=8)
    want = knn(df, id_col="id", features="v", k=4)
    assert sorted(near.select("query_id", "rank", "id").collect()) == sorted(want.select("query_id", "rank", "id").collect())
    some = knn_inverted(index, df.where("id % 5 = 0"), id_col="id", features="v", k=4, probes=3)
    assert some.groupBy("query_id").count().where(F.col("count") <= 4).count() == 80


def test_neighbours_are_searched_once(spark, monkeypatch):
    """Whether neighbours are few is seen from the finished search, which the joins then read too."""
    df = _vectors(spark).withColumn("cluster", F.col("id") % 3)
    looked = []

    def looked_at(side, *args):
        looked.append(side._jdf.queryExecution().optimizedPlan().toString())
        return side

    many = {"max_broadcast_queries": 0, "block_rows": 64, "max_pivots": 4}
    want = recommend.similar(df, id_col="id", features="v", rows=df.select("id", "v")).drop("v").collect()
    monkeypatch.setattr(recommend, "small_side", looked_at)
    got = recommend.similar(df, id_col="id", features="v", rows=df.select("id", "v"), **many).drop("v").collect()
    assert len(looked) == 2 and not any("CoGroups" in p or "Join" in p for p in looked)
    assert sorted(got) == sorted(want)
