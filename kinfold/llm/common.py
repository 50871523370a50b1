"""Helpers shared by the operators of this package: scratch tables, free names, table reading."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with underscores added until no column of `df` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{label}-{uuid.uuid4().hex}"


def arrow_filesystem(folder: str):
    """Arrow's file system and path for a folder of the shared file system, for use inside tasks."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def write_table(df: DataFrame, label: str, partition_by: str | None = None) -> str:
    """Write `df` as Parquet into the shared folder and return the path.

    A written table cuts the lineage and outlives any executor.
    """
    path = scratch_folder(df.sparkSession, label)
    out = df.write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that are read no more, and let Spark drop the shuffles of finished plans.

    Spark removes a shuffle's files when the driver's JVM has collected the plan that made them; a job that
    shuffles much in little driver memory would otherwise hold them all to its end.
    """
    import gc

    for t in tables:
        files = t.inputFiles()
        if files:
            delete_folder(spark, files[0].rpartition("/")[0])
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(id_col: str, text_col: str) -> list:
    """Two columns that tell rows apart even where ids repeat: the id and a hash of the text.

    Rows that agree in both are copies of one row, for which every operator gives one result.
    """
    return [
        F.col(id_col).alias("__id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__th"),
    ]


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row.

    Inside a lambda the optimiser may put a column's whole expression in place of the column, which would
    compute it again for each element; a lambda's own variable is a value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
