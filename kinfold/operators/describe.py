"""Descriptions of a feature table, each one pass of partial aggregates (plus a bounds pass
for histograms), returned in long form: one row per feature, pair or bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import nan_as_null
from .quantiles import exact_quantiles


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _long(wide: DataFrame, names: Sequence[str], key: str, fields: dict) -> DataFrame:
    """Turn one row of `<i>_<field>` columns into one row per name."""
    rows = [
        F.struct(F.lit(c).alias(key), *[F.col(f"{i}_{f}").alias(f) for f in fields])
        for i, c in enumerate(names)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _per_feature(df: DataFrame, features: Sequence[str], fields: dict) -> DataFrame:
    wide = df.agg(
        *[make(c).alias(f"{i}_{f}") for i, c in enumerate(features) for f, make in fields.items()]
    )
    return _long(wide, features, "feature", fields)


def _missing(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """n_rows, mean, sample std, min, max and missing count per existing feature."""
    features = [c for c in features if c in df.columns]
    if not features:
        empty = (
            "feature string, n_rows long, mean double, std double, "
            "min double, max double, missing long"
        )
        return df.sparkSession.createDataFrame([], empty)
    return _per_feature(
        nan_as_null(df, features),
        features,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "mean": lambda c: F.avg(_d(c)),
            "std": lambda c: F.stddev_samp(_d(c)),
            "min": lambda c: F.min(_d(c)),
            "max": lambda c: F.max(_d(c)),
            "missing": _missing,
        },
    )


def missing_counts(df: DataFrame, features: Sequence[str], only_missing: bool = False) -> DataFrame:
    """Nulls and NaNs per feature; `only_missing` keeps the features that have any."""
    out = _per_feature(nan_as_null(df, list(features)), list(features), {"missing": _missing})
    return out.where("missing > 0") if only_missing else out


def missing_total(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return missing_counts(df, features).agg(F.sum("missing").alias("missing"))


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per feature."""
    features = list(features)
    df = nan_as_null(df, features)
    fields = {
        "count": F.count,
        "mean": lambda c: F.avg(_d(c)),
        "std": lambda c: F.stddev_samp(_d(c)),
        "min": lambda c: F.min(_d(c)),
        "max": lambda c: F.max(_d(c)),
    }
    quartiles = exact_quantiles(df, features, [0.25, 0.5, 0.75])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("q")) for c in features]
    q_long = quartiles.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.feature",
        F.get("r.q", F.lit(0)).alias("p25"),
        F.get("r.q", F.lit(1)).alias("p50"),
        F.get("r.q", F.lit(2)).alias("p75"),
    )
    return _per_feature(df, features, fields).join(F.broadcast(q_long), "feature")


def table_info(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, non-null count and row count."""
    names = df.columns
    types = dict(df.dtypes)
    df = nan_as_null(df, [c for c in names if types[c] in ("double", "float")])
    wide = df.agg(
        *[F.count(F.col(c)).alias(f"{i}_non_null") for i, c in enumerate(names)],
        F.count(F.lit(1)).alias("n_rows"),
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("data_type"),
            F.col(f"{i}_non_null").alias("non_null"),
            F.col("n_rows").alias("n_rows"),
        )
        for i, c in enumerate(names)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_check(df: DataFrame, features: Sequence[str]) -> dict[str, bool]:
    return {c: c in df.columns for c in features}


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    The exact form shuffles (column, value) pairs after a map-side distinct, so the
    work splits by value; a single `count(distinct a), count(distinct b)` would plan
    the same expansion but end in one global group.
    """
    columns = list(columns)
    if approximate:
        wide = df.agg(
            *[
                F.approx_count_distinct(c, 0.01).alias(f"{i}_n_distinct")
                for i, c in enumerate(columns)
            ]
        )
        return _long(wide, columns, "column_name", {"n_distinct": None})
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
                for c in columns
            ]
        )
    )
    seen = df.select(pairs.alias("p")).select("p.*").where("v is not null").distinct()
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    counts = seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "column_name", "left").select(
        "column_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_distinct")
    )


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson over pairwise complete rows; null where a feature is constant.

    d(d+1)/2 aggregates in one pass over the table, mirrored afterwards on d*d rows.
    """
    features = list(features)
    df = nan_as_null(df, features)
    aggs = []
    for i, a in enumerate(features):
        for j, b in enumerate(features[i:], start=i):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, _d(a)), F.when(both, _d(b))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggs.append(r.alias(f"{i}_{j}"))
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(a).alias("feature_a"),
            F.lit(b).alias("feature_b"),
            F.col(f"{min(i, j)}_{max(i, j)}").alias("correlation"),
        )
        for i, a in enumerate(features)
        for j, b in enumerate(features)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, features: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between each feature's min and max; the last bin is closed.

    Zero-count bins are kept. A constant feature falls in bin 1 of the unit-wide
    range centred on its value.
    """
    features = list(features)
    df = nan_as_null(df, features)
    lo_hi = df.agg(
        *[F.min(_d(c)).alias(f"lo{i}") for i, c in enumerate(features)],
        *[F.max(_d(c)).alias(f"hi{i}") for i, c in enumerate(features)],
    ).first()
    bounds = {}
    for i, c in enumerate(features):
        lo, hi = lo_hi[f"lo{i}"], lo_hi[f"hi{i}"]
        if lo is None:
            continue
        bounds[c] = (lo, hi) if lo < hi else (lo - 0.5, hi + 0.5)

    def bin_of(c: str) -> Column:
        lo, hi = bounds[c]
        position = F.floor((_d(c) - F.lit(lo)) / F.lit((hi - lo) / bins)) + 1
        # `least` skips nulls, which belong in no bin.
        return F.when(position.isNotNull(), F.least(position, F.lit(bins))).cast("int")

    rows = [F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in bounds]
    counts = (
        df.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .where("bin is not null")
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.createDataFrame(
        [
            (c, b + 1, lo + b * (hi - lo) / bins, lo + (b + 1) * (hi - lo) / bins)
            for c, (lo, hi) in bounds.items()
            for b in range(bins)
        ],
        "feature string, bin int, bin_low double, bin_high double",
    )
    return frame.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", "bin_low", "bin_high", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
