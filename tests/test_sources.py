import json

import pytest
from pyspark.sql import functions as F

from kinfold.operators.clean import FeatureProcessor
from kinfold.operators.clustering import fit_clusters
from kinfold.plans.workflow import analyse, demo_recommendations, summary
from kinfold.sources import files, nested, state
from kinfold.streaming.score import score


def test_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('id,name,energy\n1,"a, ""b""",0.5\n2,,\n3,c,NaN\n')
    inferred = files.load_csv(spark, str(f)).orderBy("id").collect()
    assert inferred[0]["name"] == 'a, "b"' and inferred[1].energy is None and inferred[2].energy is None
    typed = files.load_dataset(spark, str(f), "id int, name string, energy double")
    assert typed.where("energy is null").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.load_csv(spark, str(tmp_path / "absent.csv"))


def test_cache(spark, tmp_path):
    schema = "id string, energy double"
    df = spark.createDataFrame([("a", 0.1), ("b", None)], schema)
    path = str(tmp_path / "deep" / "cache")
    files.save_cache(df, path)
    files.save_cache(df, path)
    assert sorted(files.load_cache(spark, path, schema).collect()) == sorted(df.collect())
    assert files.load_cache(spark, str(tmp_path / "none"), schema).count() == 0
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"id": "a", "energy": 0.1}, {"id": "b", "energy": None}], indent=2))
    assert files.load_cache(spark, str(array), schema).count() == 2


def _track(i, **more):
    return {
        "id": i, "name": f"n{i}", "artists": [{"name": "x"}, {"name": "y"}], "album": {"name": "al"},
        "popularity": 3, "duration_ms": 1, "explicit": False, **more,
    }


def test_pages(spark, tmp_path):
    pages = tmp_path / "playlist"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"items": [{"track": _track("a")}, {"track": None}], "next": "u"}))
    (pages / "2.json").write_text(json.dumps({"items": [{"track": _track("b")}], "next": None}))
    out = nested.flatten_playlist(nested.read_pages(spark, str(pages), nested.PLAYLIST_TYPE))
    rows = {r.track_id: r for r in out.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].artists == "x, y" and rows["b"].album_name == "al"
    found = tmp_path / "search"
    found.mkdir()
    (found / "1.json").write_text(json.dumps({"tracks": {"items": [_track("c"), _track("d")]}}))
    got = nested.flatten_search(nested.read_pages(spark, str(found), nested.SEARCH_TYPE))
    assert got.count() == 2 and len(got.columns) == 7


def test_enrich(spark):
    raw = spark.createDataFrame(
        [(json.dumps(_track("a")),), (json.dumps(_track("b")),), (None,)], "t string"
    )
    feats = spark.createDataFrame(
        [(json.dumps({"id": "a", "energy": 0.5, "duration_ms": 99}),), (None,)], "f string"
    )
    tracks = nested.parse(raw, "t", nested.TRACK_TYPE, "track")
    features = nested.parse(feats, "f", nested.FEATURES_TYPE, "features")
    rows = nested.enrich(tracks, features).collect()
    assert len(rows) == 1 and rows[0].duration_ms == 99 and rows[0].energy == 0.5
    assert nested.enrich_one(tracks, features, "a").count() == 1
    assert nested.enrich_one(tracks, features, "b").count() == 0


def test_processor_round_trip(spark, tracks, tmp_path):
    fitted, _ = FeatureProcessor(scaler="robust").fit_transform(tracks)
    state.save_processor(spark, fitted, str(tmp_path / "p"))
    again = state.load_processor(spark, str(tmp_path / "p"))
    assert again == fitted
    a = fitted.transform(tracks).orderBy("track_id").collect()
    assert a == again.transform(tracks).orderBy("track_id").collect()


def test_model_round_trips_and_refit(spark, three_groups, tmp_path):
    features = [f"f{i}" for i in range(5)]
    model, _ = fit_clusters(three_groups, features, k=3, n_init=1)
    path = str(tmp_path / "m")
    fits = []

    def fit():
        fits.append(1)
        return model

    mark = state.fingerprint(three_groups, features)
    for _ in range(2):
        got = state.fit_or_load(spark, path, mark, state.load_clusters, fit, state.save_clusters)
        assert got == model
    assert len(fits) == 1
    other = state.fingerprint(three_groups.where("id > 0"), features)
    assert other != mark
    state.fit_or_load(spark, path, other, state.load_clusters, fit, state.save_clusters)
    assert len(fits) == 2


def test_kmeans_round_trip(spark, three_groups, tmp_path):
    from kinfold.operators.kmeans import fit_kmeans

    fit = fit_kmeans(three_groups, ["f0", "f1"], 2, n_init=1)
    state.save_kmeans(fit.model, str(tmp_path / "k"))
    again = state.load_kmeans(str(tmp_path / "k"))
    assert [list(c) for c in again.clusterCenters()] == [list(c) for c in fit.model.clusterCenters()]


def test_whole_job(spark, tracks, tmp_path):
    result = analyse(
        tracks, "track_id", state_dir=str(tmp_path / "state"), report_dir=str(tmp_path / "reports"),
        k=4, n_init=2,
    )
    assert result.model.n_clusters == 4
    assert result.overview().count() == 4
    assert tuple(summary(result).first()) == (100, 4)
    for name in ("scatter", "distribution", "distribution_outliers", "heatmap", "overview"):
        spark.read.parquet(str(tmp_path / "reports" / name)).count()
    demo = demo_recommendations(result, "track_id").collect()
    assert len(demo) <= 9 and all(r.query_id != r.track_id for r in demo)
    again = analyse(tracks, "track_id", state_dir=str(tmp_path / "state"), k=4, n_init=2)
    assert again.model == result.model


def test_stream_scoring(spark, tracks, tmp_path):
    """The fitted steps give the same rows on a stream as on a table."""
    fitted, prepared = FeatureProcessor().fit_transform(tracks)
    model, _ = fit_clusters(prepared, fitted.feature_columns, k=3, n_init=1)
    source = str(tmp_path / "in")
    tracks.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(tracks.schema).parquet(source)
    q = (
        score(stream, fitted, model)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = score(tracks, fitted, model)
    cols = ["track_id", "cluster", "mood", F.round("energy", 9).alias("energy")]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
