import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import clean, describe
from kinfold.operators.quantiles import exact_quantiles
from kinfold.presets import AUDIO_FEATURES, CONTINUOUS_FEATURES


def test_initial_state():
    p = clean.FeatureProcessor()
    assert p.scaler == "standard" and not p.is_fitted and p.feature_columns == []
    assert p.features == AUDIO_FEATURES and len(AUDIO_FEATURES) == 11


def test_fit_transform_keeps_rows_and_encodes(tracks):
    fitted, out = clean.FeatureProcessor().fit_transform(tracks)
    assert fitted.is_fitted and out.count() == 100
    for gone in ("key", "mode"):
        assert gone not in out.columns
        assert f"{gone}_sin" in out.columns and f"{gone}_cos" in out.columns
    stats = out.agg(F.avg("energy"), F.stddev_pop("energy"), F.max(F.abs("mode_sin"))).first()
    assert abs(stats[0]) < 1e-9 and abs(stats[1] - 1) < 1e-9 and stats[2] == 0.0


@pytest.mark.parametrize("scaler", clean.SCALERS)
def test_scalers_keep_length(tracks, scaler):
    _, out = clean.FeatureProcessor(scaler=scaler).fit_transform(tracks)
    assert out.count() == 100


def test_injected_outliers_are_removed(tracks):
    bad = tracks.withColumn(
        "danceability", F.when(F.col("track_id") == "track_0", 10.0).otherwise(F.col("danceability"))
    ).withColumn("energy", F.when(F.col("track_id") == "track_1", -5.0).otherwise(F.col("energy")))
    kept = clean.remove_outliers(bad, AUDIO_FEATURES)
    assert {r.track_id for r in kept.select("track_id").collect()} == {
        f"track_{i}" for i in range(2, 100)
    }


def test_circular_values(tracks):
    rows = clean.encode_circular_features(tracks.withColumn("k0", F.col("key"))).collect()
    for r in rows:
        assert abs(r.key_sin - math.sin(2 * math.pi * r.k0 / 12)) < 1e-12
        assert abs(r.key_cos - math.cos(2 * math.pi * r.k0 / 12)) < 1e-12
        assert r.mode_sin == 0.0


def test_circular_absent_column_is_noop(tracks):
    assert clean.circular_encode(tracks, "nope", 12).columns == tracks.columns


def test_errors(tracks):
    with pytest.raises(ValueError, match="fitted"):
        clean.FeatureProcessor().transform(tracks)
    with pytest.raises(ValueError, match="scaler"):
        clean.FeatureProcessor(scaler="nope")
    with pytest.raises(ValueError, match="outlier"):
        clean.remove_outliers(tracks, ["energy"], method="nope")
    with pytest.raises(ValueError, match="No feature columns"):
        clean.FeatureProcessor().fit_transform(tracks.select("track_id"))


def test_transform_uses_stored_parameters(tracks):
    fitted, out = clean.FeatureProcessor().fit_transform(tracks, remove=False)
    again = fitted.transform(tracks)
    a = out.orderBy("track_id").toPandas()[fitted.feature_columns]
    b = again.orderBy("track_id").toPandas()[fitted.feature_columns]
    assert np.allclose(a, b, atol=0)


def test_nulls_nan_and_constants(spark):
    pdf = pd.DataFrame(
        {"id": range(5), "a": [1.0, 2.0, None, 4.0, float("nan")], "c": [3.0] * 5}
    )
    df = spark.createDataFrame(pdf)
    df = clean.nan_as_null(df, ["a", "c"])
    # Null rows are never outliers, a constant feature has none.
    for method in clean.OUTLIER_METHODS:
        assert clean.remove_outliers(df, ["a", "c"], method).count() == 5
    filled = [r.a for r in clean.impute_median(df, ["a"]).orderBy("id").collect()]
    assert filled == [1.0, 2.0, 2.0, 4.0, 2.0]
    for kind in clean.SCALERS:
        assert [r.c for r in clean.scale(df, ["c"], kind).collect()] == [0.0] * 5
    corr = {(r.feature_a, r.feature_b): r.correlation
            for r in describe.correlation_matrix(df, ["a", "c"]).collect()}
    assert corr[("a", "c")] is None and abs(corr[("a", "a")] - 1) < 1e-12


def test_later_nulls_are_imputed(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "energy double")
    fitted, _ = clean.FeatureProcessor(features=["energy"]).fit_transform(train)
    out = fitted.transform(spark.createDataFrame([(None,), (2.5,)], "energy double")).collect()
    assert out[0].energy == out[1].energy == 0.0


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(
        [(0.8, 0.7, 0.6, 120, -5), (0.6, 0.5, 0.4, 140, -10), (0.9, 0.8, 0.7, 100, -3)],
        "danceability double, energy double, valence double, tempo int, loudness int",
    )


def test_summary(tiny, spark):
    rows = describe.feature_summary(tiny, CONTINUOUS_FEATURES).collect()
    assert len(rows) == 5 and all(r.n_rows == 3 and r.missing == 0 for r in rows)
    mean = {r.feature: r["mean"] for r in rows}
    assert abs(mean["danceability"] - np.mean([0.8, 0.6, 0.9])) < 1e-12
    assert describe.feature_summary(spark.range(0).select(), CONTINUOUS_FEATURES).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(101)], "x double, c double")
    rows = describe.histogram(df, ["x", "c"], 50).collect()
    by = {(r.feature, r.bin): r.n for r in rows}
    assert sum(n for (f, _), n in by.items() if f == "x") == 101
    assert by[("x", 1)] == 2 and by[("x", 50)] == 3
    counts, _ = np.histogram([7.0] * 101, 50)
    assert [by[("c", b + 1)] for b in range(50)] == counts.tolist()


@pytest.mark.parametrize("limits", [{}, {"direct_limit": 10, "bracket_limit": 20, "accuracy": 200}])
def test_quantiles_match_numpy(spark, limits):
    """Skewed, heavily repeated and constant columns, on both plans."""
    rng = np.random.RandomState(1)
    n = 4000
    pdf = pd.DataFrame(
        {
            "a": rng.lognormal(0, 2, n),
            "b": np.where(rng.rand(n) < 0.4, 5.0, rng.randint(0, 50, n)).astype(float),
            "c": 1.5,
        }
    )
    probs = [0.0, 0.25, 0.5, 0.777, 1.0]
    row = exact_quantiles(spark.createDataFrame(pdf).repartition(8), ["a", "b", "c"], probs, **limits).first()
    for c in pdf:
        assert np.allclose(row[c], np.quantile(pdf[c], probs), rtol=1e-12), c


@pytest.mark.parametrize("limits", [{}, {"direct_limit": 10, "bracket_limit": 20, "accuracy": 200}])
def test_grouped_quantiles(spark, limits):
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame({"g": rng.choice(["x", "x", "x", "y", "z"], 3000), "v": rng.randn(3000)})
    out = exact_quantiles(spark.createDataFrame(pdf), ["v"], [0.25, 0.9], by=["g"], **limits)
    for r in out.collect():
        assert np.allclose(r.v, np.quantile(pdf.v[pdf.g == r.g], [0.25, 0.9]), rtol=1e-12)
