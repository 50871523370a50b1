"""Flattening landed API payloads (JSON) into feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..presets import AUDIO_FEATURES

TRACK_TYPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("artists", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("album", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("popularity", T.IntegerType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("explicit", T.BooleanType()),
    ]
)
FEATURES_TYPE = T.StructType(
    [T.StructField("id", T.StringType())]
    + [
        T.StructField(c, T.IntegerType() if c in ("key", "mode") else T.DoubleType())
        for c in AUDIO_FEATURES
    ]
    + [T.StructField("duration_ms", T.IntegerType())]
)
SEARCH_TYPE = T.StructType(
    [
        T.StructField(
            "tracks", T.StructType([T.StructField("items", T.ArrayType(TRACK_TYPE))])
        )
    ]
)
PLAYLIST_TYPE = T.StructType(
    [
        T.StructField(
            "items", T.ArrayType(T.StructType([T.StructField("track", TRACK_TYPE)]))
        ),
        T.StructField("next", T.StringType()),
    ]
)


def track_columns(track: str = "track") -> list[Column]:
    """The seven flat columns of a track struct."""
    names = F.transform(F.col(f"{track}.artists"), lambda a: a["name"])
    return [
        F.col(f"{track}.id").alias("track_id"),
        F.col(f"{track}.name").alias("track_name"),
        F.array_join(names, ", ").alias("artists"),
        F.col(f"{track}.album.name").alias("album_name"),
        F.col(f"{track}.popularity").alias("popularity"),
        F.col(f"{track}.duration_ms").alias("duration_ms"),
        F.col(f"{track}.explicit").alias("explicit"),
    ]


def parse(df: DataFrame, json_col: str, schema: T.DataType, name: str) -> DataFrame:
    """Add a struct parsed from JSON text; unreadable text gives null.

    The one-element explode keeps the parse in one place: as a plain column it would be
    repeated in every filter and join key that Catalyst derives from it.
    """
    return df.withColumn(name, F.explode(F.array(F.from_json(json_col, schema))))


def enrich(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Flat rows for the tracks that have features.

    `tracks` holds a struct column `track`, `features` a struct column `features`; entries
    that are null on either side are left out, and where both sides carry a column the
    features side wins.
    """
    flat = tracks.where("track is not null").select(*track_columns())
    own = features.where("features is not null").select("features.*")
    own = own.withColumnRenamed("id", "track_id")
    clash = [c for c in flat.columns if c in own.columns and c != "track_id"]
    joined = flat.drop(*clash).join(own, "track_id")
    order = [*flat.columns, *[c for c in own.columns if c not in flat.columns]]
    return joined.select(*order)


def enrich_one(tracks: DataFrame, features: DataFrame, track_id: str) -> DataFrame:
    """`enrich` for one id; the filter reaches both sides before the join."""
    return enrich(
        tracks.where(F.col("track.id") == track_id), features.where(F.col("features.id") == track_id)
    )


def flatten_search(pages: DataFrame, page: str = "page") -> DataFrame:
    """One row per found track; `page` is a search result struct."""
    return pages.select(F.explode(F.col(f"{page}.tracks.items")).alias("track")).select(
        *track_columns()
    )


def flatten_playlist(pages: DataFrame, page: str = "page") -> DataFrame:
    """One row per playlist entry over all pages; entries without a track are left out."""
    return (
        pages.select(F.explode(F.col(f"{page}.items.track")).alias("track"))
        .where("track is not null")
        .select(*track_columns())
    )


def read_pages(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All landed page files of a folder in one scan, one struct column `page`."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.struct("*").alias("page")
    )
