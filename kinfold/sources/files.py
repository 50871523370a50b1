"""Table files: CSV and Parquet in, JSON cache in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import nan_as_null
from ..presets import CONTINUOUS_FEATURES

# Spellings of a missing value in CSV files.
NULL_VALUES = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")

TRACK_SCHEMA = T.StructType(
    [
        T.StructField("track_id", T.StringType()),
        T.StructField("artists", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("popularity", T.IntegerType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("explicit", T.BooleanType()),
        *[T.StructField(c, T.DoubleType()) for c in CONTINUOUS_FEATURES],
        T.StructField("key", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
    ]
)


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    null_values: Sequence[str] = NULL_VALUES,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header; `null_values` are the spellings of a missing value, NaN in a number too.

    Give a schema for large data: inferring types reads the file twice. `multi_line` reads
    quoted line breaks, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    text = reader.csv(path)
    names = text.columns
    if schema is not None:
        want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if [c.lower() for c in names] != [c.lower() for c in want.names]:
            raise ValueError(f"The file has the columns {names}, not {want.names}")
    # Only CSV's own reader infers types, so the spellings are blanked before it sees the values.
    clean = text.select(
        *[F.when(~F.col(f"`{c}`").isin(list(null_values)), F.col(f"`{c}`")).alias(c) for c in names]
    )
    if schema is None:
        want = _inferred(clean)
    return nan_as_null(
        clean.select(
            *[
                (F.col(f"`{c}`") if f.dataType == T.StringType() else F.expr(f"try_cast(`{c}` as {f.dataType.simpleString()})")).alias(f.name)
                for c, f in zip(names, want.fields, strict=True)
            ]
        ),
        want.names,
    )


def _inferred(df: DataFrame) -> T.StructType:
    """The narrowest of int, bigint, double, boolean, timestamp that takes every value, else string."""
    kinds = ["int", "bigint", "double", "boolean", "timestamp"]
    checks = [
        F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` as {k})").isNull()).alias(f"{i}_{k}")
        for i, c in enumerate(df.columns)
        for k in kinds
    ]
    some = [F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*checks, *some).first()
    fields = []
    for i, c in enumerate(df.columns):
        fit = next((k for k in kinds if row[f"{i}_n"] and not row[f"{i}_{k}"]), "string")
        fields.append(T.StructField(c, T.StructType.fromDDL(f"x {fit}").fields[0].dataType))
    return T.StructType(fields)


def load_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet or CSV by the path's ending."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return nan_as_null(df, df.columns)
    return load_csv(spark, path, schema)


def save_cache(df: DataFrame, path: str) -> None:
    """JSON Lines, one file per partition; an existing cache is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_cache(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON cache, empty with the given schema if there is none.

    Reads JSON Lines folders, and single files holding one JSON array when the name ends
    in `.json`.
    """
    array_file = path.endswith(".json")
    try:
        return spark.read.schema(schema).option("multiLine", array_file).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
