"""One answer at every size and for every spelling of a missing value."""

import math

import numpy as np
import pytest
from conftest import shifted

from kinfold.operators import clean, clustering, clusters, describe, hierarchy, kmeans, quality, recommend, report, search
from kinfold.plans.workflow import analyse
from kinfold.sources import files

FEATURES = [f"f{i}" for i in range(5)]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_silhouette_of_one_label(spark, limit):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, cluster int")
    assert quality.silhouette(df, ["x"], max_broadcast_rows=limit).first()[0] == -1.0


def test_squared_silhouette_of_one_label(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, cluster int")
    assert quality.silhouette_squared(df, ["x"]) == -1.0


@pytest.mark.parametrize("flat", [256, 0])
def test_missing_feature_has_no_nearest_centre(spark, monkeypatch, flat):
    monkeypatch.setattr(kmeans, "FLAT_TERMS", flat)
    df = spark.createDataFrame([(1, 0.1, 0.0), (2, None, 0.0), (3, math.nan, 1.0), (4, 5.0, 5.0)], "id int, a double, b double")
    out = kmeans.assign_nearest(df, ["a", "b"], [[0.0, 0.0], [5.0, 5.0]], distance="d")
    got = {r.id: (r.cluster, r.d) for r in out.collect()}
    assert got[2] == got[3] == (None, None)
    assert got[1][0] == 0 and got[4] == (1, 0.0)


def test_more_results_than_neighbours(recommender_rows):
    kw = {"id_col": "track_id", "features": FEATURES}
    with pytest.raises(ValueError, match="n_neighbors"):
        recommend.similar(recommender_rows, n=30, **kw)
    out = recommend.similar(recommender_rows, n=30, mode="any", **kw)
    assert out.groupBy("query_id").count().where("count <> 30").count() == 0


def test_squared_mode_has_all_scores(spark):
    df = spark.createDataFrame(shifted([slice(0, 30), slice(30, 60), slice(60, 100)], by=8.0))
    best, scores = kmeans.find_optimal_k(df, FEATURES, 4, n_init=2, silhouette="squared")
    rows = scores.collect()
    assert best == 3 and len(rows) == 3
    assert all(None not in tuple(r) for r in rows)


def test_labels_must_match_both_ways(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    labels = spark.createDataFrame([(1, 5), (3, 6)], "id int, cluster int")
    with pytest.raises(ValueError, match="same ids"):
        clusters.align_labels(rows, labels, "id")


def test_nan_is_missing_everywhere(spark):
    values = [(float(i), float(i)) for i in range(20)]
    null = spark.createDataFrame([*values, (None, 3.0), (500.0, 3.0)], "a double, b double")
    nan = spark.createDataFrame([*values, (math.nan, 3.0), (500.0, 3.0)], "a double, b double")
    for f in (describe.feature_summary, describe.missing_counts, describe.describe):
        assert sorted(f(null, ["a", "b"]).collect()) == sorted(f(nan, ["a", "b"]).collect())
    for method, t in (("iqr", 1.5), ("zscore", 3.0)):
        got = [clean.remove_outliers(d, ["a", "b"], method, t) for d in (null, nan)]
        assert got[0].count() == got[1].count() == 21
    scaled = [sorted(clean.scale(d, ["a", "b"]).select("b").collect()) for d in (null, nan)]
    assert scaled[0] == scaled[1]


def test_search_ignores_case_of_every_letter(spark):
    df = spark.createDataFrame([(1, "BEYONCÉ"), (2, "beyonce")], "id int, name string")
    assert [r.id for r in search.text_search(df, "beyoncé", ["name"], "id").collect()] == [1]


def test_csv_spellings_of_missing(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('id,energy,name\n1,NA,a\n2,0.5,null\n3,NaN,"x\ny"\n')
    out = files.load_csv(spark, str(f), multi_line=True)
    assert dict(out.dtypes) == {"id": "int", "energy": "double", "name": "string"}
    assert sorted((r.id, r.energy, r.name) for r in out.collect()) == [(1, None, "a"), (2, 0.5, None), (3, None, "x\ny")]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0,), (math.nan,)], "x double").write.parquet(path)
    assert files.load_dataset(spark, path).where("x IS NULL").count() == 1


def test_ward_keeps_its_procedure(spark):
    """The same centres procedure on either side of the exact method's bound."""
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    a = hierarchy.hierarchical(df, ["x", "y"], 4, leaves=20)
    b = hierarchy.hierarchical(df.union(df), ["x", "y"], 4, leaves=20)
    assert a.count() * 2 == b.count()
    assert a.select("cluster").distinct().count() == b.select("cluster").distinct().count() == 4
    with pytest.raises(ValueError, match="distinct rows"):
        hierarchy.hierarchical(df, ["x", "y"], 90, method="exact")
    with pytest.raises(ValueError, match="Unknown method"):
        hierarchy.hierarchical(df, ["x", "y"], 4, method="fast")


def test_ward_chooses_its_own_k(spark):
    df = spark.createDataFrame(shifted([slice(0, 30), slice(30, 60), slice(60, 100)], by=15.0))
    model, out = clustering.fit_clusters(df, FEATURES, algorithm="agglomerative", max_k=5, leaves=20)
    assert model.params["k"] == model.n_clusters == 3
    assert [s["k"] for s in model.params["scores"]] == [2, 3, 4, 5]


def test_another_fit_is_not_taken_from_the_store(tracks, tmp_path):
    first = analyse(tracks, id_col="track_id", k=4, n_init=1, state_dir=str(tmp_path))
    again = analyse(tracks, id_col="track_id", k=2, n_init=1, state_dir=str(tmp_path))
    assert (first.model.n_clusters, again.model.n_clusters) == (4, 2)


@pytest.mark.parametrize("stored", [True, False])
def test_density_clusters_are_fitted_once(tracks, tmp_path, monkeypatch, stored):
    from kinfold.plans import workflow

    calls = []
    fit = workflow.fit_clusters
    monkeypatch.setattr(workflow, "fit_clusters", lambda *a, **k: calls.append(1) or fit(*a, **k))
    kw = {"id_col": "track_id", "algorithm": "dbscan", "eps": 3.0, "min_samples": 3}
    where = str(tmp_path / "state") if stored else None
    first = analyse(tracks, state_dir=where, **kw).prepared.select("track_id", "cluster").collect()
    assert len(calls) == 1
    if stored:
        again = analyse(tracks, state_dir=where, **kw).prepared.select("track_id", "cluster").collect()
        assert sorted(first) == sorted(again) and len(calls) == 1


def test_nan_is_missing_in_reports(spark):
    values = [(float(i), float(i % 7), i % 2) for i in range(20)]
    kind = "a double, b double, cluster int"
    null = spark.createDataFrame([*values, (None, 3.0, 0), (500.0, None, 1)], kind)
    nan = spark.createDataFrame([*values, (math.nan, 3.0, 0), (500.0, math.nan, 1)], kind)
    f = ["a", "b"]
    moods = spark.createDataFrame([(0, "m")], "cluster_id int, mood string")
    named = lambda d: d.withColumn("mood", d["cluster"].cast("string"))
    for make in (
        lambda d: describe.table_info(d),
        lambda d: describe.correlation_matrix(d, f),
        lambda d: describe.histogram(d, f, 5),
        lambda d: clusters.cluster_stats(d, f),
        lambda d: report.cluster_heatmap(d, f, moods),
        lambda d: report.boxplot_stats(named(d), f),
        lambda d: report.boxplot_outliers(named(d).withColumn("id", d["cluster"]), "id", f),
        lambda d: clean.impute_median(d, f),
    ):
        assert sorted(make(null).collect(), key=str) == sorted(make(nan).collect(), key=str)
    bins = describe.histogram(null, ["b"], 7).collect()
    assert sum(r.n for r in bins) == 21
    assert clean.impute_median(nan, f).where("isnan(a) or isnan(b) or a is null or b is null").count() == 0


def test_repeated_ids_do_not_align(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string")
    labels = spark.createDataFrame([(1, 5), (1, 6)], "id int, cluster int")
    with pytest.raises(ValueError, match="repeated"):
        clusters.align_labels(rows, labels, "id")


def test_other_ids_are_another_fit(tracks, tmp_path):
    from pyspark.sql import functions as F

    kw = {"id_col": "track_id", "algorithm": "dbscan", "eps": 3.0, "min_samples": 3, "state_dir": str(tmp_path)}
    first = analyse(tracks, **kw)
    renamed = tracks.withColumn("track_id", F.concat(F.lit("x"), "track_id"))
    again = analyse(renamed, **kw)
    n = tracks.count()
    assert again.prepared.count() == n
    assert first.prepared.count() == n  # its labels are still there
