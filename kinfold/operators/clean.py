"""Cleaning and scaling of feature tables: outliers, circular encoding, imputing, scaling.

Fitting runs one or two aggregations and keeps only per-feature numbers;
applying a fit is a pure projection, so it fuses into the scan and also works
on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import NOISE, circular_pair, nan_to_null
from ..presets import AUDIO_FEATURES, CIRCULAR_PERIODS, available
from .quantiles import column_quantiles

SCALERS = ("standard", "minmax", "robust")
OUTLIER_METHODS = ("iqr", "zscore")


def project_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted features that exist, in the wanted order, after the `keep` columns."""
    return df.select(*keep, *available(df.columns, list(wanted)))


def nan_as_null(df: DataFrame, features: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns(
        {c: nan_to_null(F.col(c)) for c in features if types[c] in ("double", "float")}
    )


# --- outliers -------------------------------------------------------------


def outlier_bounds(
    df: DataFrame, features: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> dict[str, tuple[float, float]]:
    """Per-feature (low, high); values strictly outside are outliers."""
    if method not in OUTLIER_METHODS:
        raise ValueError(f"Unknown outlier detection method: {method}")
    features = list(features)
    df = nan_as_null(df, features)
    if method == "iqr":
        found = column_quantiles(df, features, [0.25, 0.75])
        out = {}
        for c in features:
            if found[c] is None:
                continue
            q1, q3 = found[c]
            out[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        return out
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    # For the z-score the pair is (mean, deviation); a constant feature has no outliers.
    return {
        c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(features) if row[f"s{i}"]
    }


def outlier_flag(bounds: dict[str, tuple[float, float]], method: str, threshold: float) -> Column:
    """True when any feature is out; a missing value (null or NaN) is never an outlier."""
    flag = F.lit(False)
    for c, (a, b) in bounds.items():
        x = nan_to_null(F.col(c))
        if method == "iqr":
            out = (x < F.lit(a)) | (x > F.lit(b))
        else:
            out = F.abs((x - F.lit(a)) / F.lit(b)) > F.lit(float(threshold))
        flag = flag | F.coalesce(out, F.lit(False))
    return flag


def flag_outliers(
    df: DataFrame,
    features: Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    name: str = "is_outlier",
) -> DataFrame:
    bounds = outlier_bounds(df, features, method, threshold)
    return df.withColumn(name, outlier_flag(bounds, method, threshold))


def remove_outliers(
    df: DataFrame, features: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    bounds = outlier_bounds(df, features, method, threshold)
    return df.where(~outlier_flag(bounds, method, threshold))


def outlier_report(
    df: DataFrame, features: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    flagged = flag_outliers(df, features, method, threshold)
    n_out = F.count_if("is_outlier")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        n_out.alias("n_outliers"),
        F.coalesce(F.try_divide(n_out * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)).alias(
            "outlier_percent"
        ),
    )


# --- encoding -------------------------------------------------------------


def circular_encode(df: DataFrame, column: str, period: float, drop: bool = True) -> DataFrame:
    """Replace a circular column by `<column>_sin` and `<column>_cos`; no-op if it is absent."""
    if column not in df.columns:
        return df
    s, c = circular_pair(F.col(column), period)
    out = df.withColumns({f"{column}_sin": s, f"{column}_cos": c})
    return out.drop(column) if drop else out


def encode_circular_features(df: DataFrame, periods: dict[str, float] | None = None) -> DataFrame:
    for column, period in (CIRCULAR_PERIODS if periods is None else periods).items():
        df = circular_encode(df, column, period)
    return df


def encoded_names(features: Sequence[str], periods: dict[str, float]) -> list[str]:
    plain = [c for c in features if c not in periods]
    return plain + [f"{c}_{part}" for c in periods if c in features for part in ("sin", "cos")]


# --- imputing and scaling -------------------------------------------------


@dataclass(frozen=True)
class ScaleParams:
    """Per-feature numbers of a fit: x -> (coalesce(x, fill) - center) / scale."""

    kind: str
    features: list[str]
    fill: dict[str, float | None]
    center: dict[str, float]
    scale: dict[str, float]


def fit_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    found = column_quantiles(nan_as_null(df, list(features)), features, [0.5])
    return {c: found[c][0] if found[c] else None for c in features}


def impute_median(
    df: DataFrame, features: Sequence[str], medians: dict[str, float | None] | None = None
) -> DataFrame:
    df = nan_as_null(df, list(features))
    if medians is None:
        medians = fit_medians(df, features)
    return df.withColumns({c: _filled(c, medians.get(c)) for c in features})


def _filled(c: str, fill: float | None) -> Column:
    x = F.col(c).cast("double")
    return x if fill is None else F.coalesce(x, F.lit(float(fill)))


def _unit_if_constant(x: float | None) -> float:
    return 1.0 if x is None or abs(x) < NOISE else float(x)


def fit_scaler(
    df: DataFrame, features: Sequence[str], kind: str = "standard", impute: bool = False
) -> ScaleParams:
    """Fit on the features, nulls being ignored, or with `impute` on the features after their
    nulls became medians.

    Filling m values with a known number changes the moments in closed form, so they are taken
    from the unfilled rows, where the pass is plain generated code.
    """
    if kind not in SCALERS:
        raise ValueError(f"Unknown scaler type: {kind}")
    features = list(features)
    fill = fit_medians(df, features) if impute else dict.fromkeys(features)
    row = df.agg(*_moments(features)).first() if kind != "robust" else None
    center, spread = {}, {}
    if kind == "robust":
        filled = df.select(*[_filled(c, fill[c]).alias(c) for c in features])
        found = column_quantiles(filled, features, [0.25, 0.5, 0.75])
        for c in features:
            q1, q2, q3 = found[c] or (0.0, 0.0, 0.0)
            center[c], spread[c] = q2, q3 - q1
    for i, c in enumerate(features if kind != "robust" else ()):
        n, mean, var, low, high, missing = (row[f"{m}{i}"] for m in _MOMENTS)
        if not n:
            center[c], spread[c] = 0.0, None
        elif kind == "minmax":
            # A median lies within the range, so filling does not move it.
            center[c], spread[c] = low, high - low
        else:
            m = missing if fill[c] is not None else 0
            value = fill[c] if m else mean
            center[c] = (n * mean + m * value) / (n + m)
            total = n * (var + (mean - center[c]) ** 2) + m * (value - center[c]) ** 2
            spread[c] = (total / (n + m)) ** 0.5
    scale = {c: _unit_if_constant(spread[c]) for c in features}
    return ScaleParams(kind, features, fill, {c: float(center[c]) for c in features}, scale)


_MOMENTS = ("n", "mean", "var", "low", "high", "missing")


def _moments(features: Sequence[str]) -> list[Column]:
    out = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        makes = (F.count, F.avg, F.var_pop, F.min, F.max, lambda v: F.count_if(v.isNull()))
        out += [make(x).alias(f"{m}{i}") for m, make in zip(_MOMENTS, makes, strict=True)]
    return out


def apply_scaler(df: DataFrame, params: ScaleParams, suffix: str = "") -> DataFrame:
    """Overwrite the features (or add `<feature><suffix>`); other columns pass through."""
    missing = [c for c in params.features if c not in df.columns]
    if missing:
        raise ValueError(f"Missing feature columns: {missing}")
    return df.withColumns(
        {
            c + suffix: (_filled(c, params.fill[c]) - F.lit(params.center[c]))
            / F.lit(params.scale[c])
            for c in params.features
        }
    )


def scale(df: DataFrame, features: Sequence[str], kind: str = "standard") -> DataFrame:
    df = nan_as_null(df, features)
    return apply_scaler(df, fit_scaler(df, features, kind))


# --- the whole preparation ------------------------------------------------


@dataclass(frozen=True)
class FeatureProcessor:
    """Outliers -> circular encoding -> imputing -> scaling, in that order."""

    features: list[str] = field(default_factory=lambda: list(AUDIO_FEATURES))
    scaler: str = "standard"
    outlier_method: str = "iqr"
    outlier_threshold: float = 1.5
    periods: dict[str, float] = field(default_factory=lambda: dict(CIRCULAR_PERIODS))
    params: ScaleParams | None = None

    def __post_init__(self):
        if self.scaler not in SCALERS:
            raise ValueError(f"Unknown scaler type: {self.scaler}")
        if self.outlier_method not in OUTLIER_METHODS:
            raise ValueError(f"Unknown outlier detection method: {self.outlier_method}")

    @property
    def is_fitted(self) -> bool:
        return self.params is not None

    @property
    def feature_columns(self) -> list[str]:
        """Encoded feature names of the fit."""
        return list(self.params.features) if self.params else []

    def fit_transform(
        self, df: DataFrame, remove: bool = True
    ) -> tuple[FeatureProcessor, DataFrame]:
        """The fitted processor and the prepared table (lazy; only parameters are computed)."""
        found = available(df.columns, self.features)
        if not found:
            raise ValueError("No feature columns found in the table")
        df = nan_as_null(df, found)
        if remove:
            df = remove_outliers(df, found, self.outlier_method, self.outlier_threshold)
        df = encode_circular_features(df, self.periods)
        names = encoded_names(found, self.periods)
        params = fit_scaler(df, names, self.scaler, impute=True)
        return replace(self, params=params), apply_scaler(df, params)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode, impute and scale new rows with the stored parameters; no outlier filter."""
        if self.params is None:
            raise ValueError("Processor must be fitted before transform")
        df = nan_as_null(df, available(df.columns, self.features))
        return apply_scaler(encode_circular_features(df, self.periods), self.params)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> FeatureProcessor:
        d = dict(d)
        d["params"] = ScaleParams(**d["params"]) if d.get("params") else None
        return cls(**d)
