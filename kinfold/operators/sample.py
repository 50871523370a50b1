"""Repeatable sampling by hash order.

A row's place depends only on its key and the seed, so the same rows come back
whatever the partitioning, and a lost task that is run again picks them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows without replacement: a top-n per partition, then one merge of n rows each."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def sample_per_group(
    df: DataFrame, id_col: str, group: str, n: int = 1, seed: int = 42, rank: str | None = None
) -> DataFrame:
    """`n` rows of every group; ranks are cut before the shuffle, so a hot group sends n rows
    per task."""
    name = rank or "__rank"
    w = Window.partitionBy(group).orderBy(hash_order(id_col, seed), id_col)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)
