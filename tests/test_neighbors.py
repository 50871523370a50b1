import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import recommend, report, sample, search
from kinfold.operators.kernels import distances
from kinfold.operators.knn import knn
from kinfold.plans.workflow import Recommender, build_recommender

FEATURES = [f"f{i}" for i in range(5)]
TILES = {"max_broadcast_queries": 3, "block_rows": 16, "max_pivots": 6}


def _brute(x, ids, k, metric, p, groups=None):
    d = distances(x, x, metric, p)
    out = {}
    for i in range(len(x)):
        rows = [(d[i, j], ids[j]) for j in range(len(x)) if groups is None or groups[j] == groups[i]]
        out[ids[i]] = sorted(rows)[:k]
    return out


@pytest.fixture(scope="module")
def copied(spark):
    """Rows with copies, a zero vector twice, and one group holding most rows."""
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.randn(60, 3), np.repeat(rng.randn(1, 3), 30, 0), np.zeros((2, 3))])
    x = x.round(1)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["id"] = np.arange(len(x))
    pdf["g"] = np.where(rng.rand(len(x)) < 0.7, 0, rng.randint(1, 4, len(x)))
    return pdf


@pytest.mark.parametrize("plan", [{}, TILES])
@pytest.mark.parametrize("within", [None, "g"])
@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("cosine", 2.0), ("manhattan", 1.0), ("minkowski", 3.0)])
def test_knn_matches_brute_force(spark, copied, plan, within, metric, p):
    out = knn(
        spark.createDataFrame(copied).repartition(5), id_col="id", features=["a", "b", "c"], k=6,
        metric=metric, p=p, within=within, **plan,
    ).toPandas()
    x = copied[["a", "b", "c"]].values
    want = _brute(x, copied.id.values, 6, metric, p, copied.g.values if within else None)
    assert len(out) == sum(len(v) for v in want.values())
    for q, g in out.sort_values("rank").groupby("query_id"):
        assert np.allclose(g.distance.values, [d for d, _ in want[q]], atol=1e-9)
        # Neighbours agree wherever distances are not tied up to rounding.
        dist = np.array([d for d, _ in want[q]])
        if metric == "euclidean":
            exact = np.array([((x[q] - x[i]) ** 2).sum() for i in g.id.values])
            assert np.allclose(np.sqrt(exact), dist, atol=1e-9)
            same = np.flatnonzero(g.distance.values == 0)
            assert [i for _, i in want[q]][: len(same)] == g.id.values[: len(same)].tolist()


@pytest.mark.parametrize("plan", [{}, TILES])
def test_knn_other_queries(spark, plan):
    rng = np.random.RandomState(6)
    points = pd.DataFrame(rng.rand(200, 2), columns=["a", "b"]).assign(id=[f"p{i}" for i in range(200)])
    asked = pd.DataFrame(rng.rand(30, 2) * 1.2, columns=["a", "b"]).assign(id=[f"q{i}" for i in range(30)])
    out = knn(
        spark.createDataFrame(points), spark.createDataFrame(asked), id_col="id", features=["a", "b"],
        k=4, **plan,
    ).toPandas()
    d = distances(asked[["a", "b"]].values, points[["a", "b"]].values)
    for i, q in enumerate(asked.id):
        g = out[out.query_id == q].sort_values("rank")
        assert [f"p{j}" for j in np.argsort(d[i])[:4]] == g.id.tolist()


@pytest.mark.parametrize("batch", [10000, 7])
def test_tiles_skip_far_blocks(spark, batch):
    """Well separated groups are not compared with each other, yet nothing is missed, also
    when blocks span several Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        _far_blocks(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_block_sizes(spark):
    from kinfold.operators.blocks import pack_blocks

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        v = F.array(F.rand(1))
        df = spark.range(500).select("id", F.lit(0).alias("g"), v.alias("v"), F.lit(True).alias("first"))
        df = df.withColumn("u", F.col("v"))
        rows = pack_blocks(df, np.array([[0.2], [0.7]]), distances, rows=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(i for r in rows for i in r.ids) == list(range(500))
    # Full blocks but for the last of each cell and partition.
    assert max(r.n for r in rows) == 20 and sum(r.n < 20 for r in rows) <= 2 + 8
    for r in rows:
        pivot = [0.2, 0.7][r.cell]
        far = [abs(x - pivot) for x in r.v]
        assert r.block == r.ids[0] and r.n == len(r.ids) == len(r.v)
        assert abs(min(far) - r.low) < 1e-12 and abs(max(far) - r.high) < 1e-12


def _far_blocks(spark):
    rng = np.random.RandomState(7)
    x = np.concatenate([rng.randn(50, 2) + 1000 * i for i in range(4)])
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(200))
    out = knn(
        spark.createDataFrame(pdf), id_col="id", features=["a", "b"], k=3,
        max_broadcast_queries=1, block_rows=25, max_pivots=4,
    ).toPandas()
    want = _brute(x, np.arange(200), 3, "euclidean", 2.0)
    for q, g in out.sort_values("rank").groupby("query_id"):
        assert g.id.tolist() == [i for _, i in want[q]]


def test_knn_errors(spark, copied):
    df = spark.createDataFrame(copied)
    with pytest.raises(ValueError, match="metric"):
        knn(df, id_col="id", features=["a"], metric="nope")
    holes = df.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    with pytest.raises(Exception, match="missing values"):
        knn(holes, id_col="id", features=["a", "b"], k=2).collect()


def test_fewer_rows_than_neighbours(spark, copied):
    df = spark.createDataFrame(copied.head(5))
    out = knn(df, id_col="id", features=["a", "b", "c"], k=21)
    assert out.count() == 25


def _similar(df, ids, **kw):
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "track_id string")
    return recommend.similar(df, id_col="track_id", features=FEATURES, ids=wanted, **kw)


def test_recommendations(recommender_rows):
    out = _similar(recommender_rows, ["track_0"], n=5, rows=recommender_rows)
    rows = out.collect()
    assert len(rows) <= 5
    for c in ("track_id", "track_name", "artists", "similarity_score", "distance"):
        assert c in out.columns
    own = recommender_rows.where("track_id = 'track_0'").first().cluster
    for r in rows:
        assert r.cluster == own and r.track_id != "track_0"
        assert abs(r.similarity_score - 1 / (1 + r.distance)) < 1e-12


def test_prefilter_fills_up(recommender_rows):
    pre = _similar(recommender_rows, ["track_0"], n=10, mode="prefilter")
    assert pre.count() == 10
    assert _similar(recommender_rows, ["track_0"], n=10).count() <= 10
    assert _similar(recommender_rows, ["track_0"], n=10, mode="any").count() == 10


def test_unknown_id_and_mode(recommender_rows):
    assert _similar(recommender_rows, ["nope"]).count() == 0
    asked = recommender_rows.sparkSession.createDataFrame([("nope",), ("track_1",)], "track_id string")
    reasons = dict(recommend.query_status(recommender_rows, asked, "track_id").collect())
    assert reasons == {"nope": "not in table", "track_1": None}
    with pytest.raises(ValueError, match="mode"):
        _similar(recommender_rows, ["track_0"], mode="nope")


def test_vector_query_keeps_equal_row(spark, recommender_rows):
    row = recommender_rows.where("track_id = 'track_3'").first()
    vectors = spark.createDataFrame([(0, *[row[c] for c in FEATURES])], "vid int, f0 double, f1 double, f2 double, f3 double, f4 double")
    out = recommend.similar_to_vectors(
        recommender_rows, vectors, id_col="track_id", features=FEATURES, vector_id="vid", n=4
    ).orderBy("rank").collect()
    assert len(out) == 4 and out[0].track_id == "track_3" and out[0].distance == 0.0
    kept = recommend.similar_to_vectors(
        recommender_rows, vectors.withColumn("w", F.lit(row.cluster)), id_col="track_id",
        features=FEATURES, vector_id="vid", cluster="cluster", wanted_cluster="w", rows=recommender_rows,
    ).collect()
    assert kept and all(r.cluster == row.cluster for r in kept)


def test_by_cluster(spark, recommender_rows):
    out = recommend.recommend_by_cluster(recommender_rows, id_col="track_id", n=5, cluster_id=2)
    rows = out.collect()
    assert len(rows) == 5 and all(r.similarity_score == 1.0 and r.distance == 0.0 and r.cluster == 2 for r in rows)
    skip = spark.createDataFrame([(r.track_id,) for r in rows], "track_id string")
    other = recommend.recommend_by_cluster(
        recommender_rows, id_col="track_id", n=5, cluster_id=2, exclude=skip
    ).collect()
    assert not {r.track_id for r in rows} & {r.track_id for r in other}
    assert recommend.recommend_by_cluster(recommender_rows, id_col="track_id", cluster_id=999).count() == 0


def test_lookup(recommender_rows):
    assert isinstance(search.entity_cluster(recommender_rows, "track_id", "track_5"), int)
    assert search.entity_cluster(recommender_rows, "track_id", "nope") is None


def test_summary(spark):
    recs = spark.createDataFrame(
        [(0.8, 0.2), (0.6, 0.4), (0.9, 0.1)], "similarity_score double, distance double"
    )
    r = recommend.recommendation_summary(recs).first()
    assert r.n_recommendations == 3 and abs(r.avg_similarity - 0.7666666666666666) < 1e-12
    assert (r.min_similarity, r.max_similarity, r.min_distance) == (0.6, 0.9, 0.1)
    e = recommend.recommendation_summary(recs.limit(0)).first()
    assert (e.n_recommendations, e.avg_similarity, e.avg_distance) == (0, 0.0, 0.0)
    assert e.min_distance is None and e.max_distance is None


def test_recommender_checks_length_and_round_trips(spark, recommender_rows, tmp_path):
    labels = recommender_rows.select("track_id", "cluster")
    rows = recommender_rows.drop("cluster")
    with pytest.raises(ValueError, match="same length"):
        build_recommender(rows, labels.limit(50), "track_id", FEATURES)
    r = build_recommender(rows, labels, "track_id", FEATURES)
    r.save(str(tmp_path / "rec"))
    again = Recommender.load(spark, str(tmp_path / "rec"))
    a = r.similar(["track_1"], n=3).select("track_id", "distance").collect()
    b = again.similar(["track_1"], n=3).select("track_id", "distance").collect()
    assert sorted(a) == sorted(b)
    assert r.members(1).count() == labels.where("cluster = 1").count()


def test_sampling_is_repeatable(recommender_rows):
    a = sample.sample_n(recommender_rows, "track_id", 7).select("track_id").collect()
    b = sample.sample_n(recommender_rows.repartition(5), "track_id", 7).select("track_id").collect()
    assert a == b and len(set(a)) == 7
    per = sample.sample_per_group(recommender_rows, "track_id", "cluster").collect()
    assert len(per) == len({r.cluster for r in per}) == 5


def test_search(spark):
    df = spark.createDataFrame(
        [(0, "Blue (live)", "Ann", None), (1, "red", "Bo", "BLUE"), (2, "x", None, "y")],
        "id int, track_name string, artists string, album_name string",
    )
    cols = ["track_name", "artists", "album_name"]
    hit = lambda q, **kw: [r.id for r in search.text_search(df, q, cols, "id", **kw).collect()]
    assert hit("blue") == [0, 1] and hit("b.o?$") == [1] and hit("") == [0, 1, 2]
    assert hit("(live)", literal=True) == [0] and hit("\\(live\\)") == [0]


def test_compare_recommendations(spark, recommender_rows):
    recs = _similar(recommender_rows, ["track_0"], n=10, mode="any")
    out = report.compare_recommendations(
        recommender_rows, recs, "track_id", ["f0", "f1", "absent"], ["track_name", "artists"]
    ).collect()
    assert len(out) == 6 * 3
    assert all(r.value == 0.0 for r in out if r.feature == "absent")
    assert {r.series_name for r in out if r.series == 0} == {"Query Track"}
    assert all(" - Artist " in r.series_name for r in out if r.series)


def test_radar(spark):
    df = spark.createDataFrame([(1, 250.0, -30.0, 5)], "id int, tempo double, loudness double, other int")
    got = {r.feature: r.value for r in report.radar_profile(df, "id").collect()}
    assert got == {"tempo": 1.25, "loudness": 0.5}
    assert report.radar_profile(df.select("id", "other"), "id").count() == 0
