import numpy as np
import pandas as pd
import pytest
from conftest import shifted
from pyspark.sql import functions as F

from kinfold.operators import clusters, hierarchy, kmeans, pca, quality, report
from kinfold.operators.clustering import fit_clusters
from kinfold.operators.components import connected_components, dense_number
from kinfold.operators.dbscan import core_points, dbscan

FEATURES = [f"f{i}" for i in range(5)]


def test_kmeans_three_clusters(three_groups):
    model, out = fit_clusters(three_groups, FEATURES, k=3, n_init=2)
    assert model.n_clusters == 3
    assert out.select("cluster").distinct().count() == 3
    assert len(model.mood_labels) == 3 and all(model.mood_labels.values())
    assert sum(model.sizes) == 100 and all(0 < p <= 100 for p in model.percentages)
    assert all(len(c) == 5 for c in model.centers) and all(len(s) == 5 for s in model.stds)
    info = model.info(model.labels[0])
    assert info["size"] == model.sizes[0] and info["mood_label"] == model.moods[0]
    with pytest.raises(ValueError, match="Cluster 999 not found"):
        model.info(999)
    # Labels on the training rows are the nearest centres.
    again = model.predict(three_groups, "again").select("id", "again").join(out, "id")
    assert again.where("again <> cluster").count() == 0


def test_kmeans_centres_are_member_means(three_groups):
    fit = kmeans.fit_kmeans(three_groups, FEATURES, 3, n_init=3)
    out = kmeans.assign_nearest(three_groups, FEATURES, fit.centers, distance="d")
    means = out.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in FEATURES]).collect()
    for r in means:
        assert np.allclose([r[c] for c in FEATURES], fit.centers[r.cluster], atol=1e-6)
    assert abs(out.agg(F.sum(F.col("d") * F.col("d"))).first()[0] - fit.cost) < 1e-6


def test_more_restarts_never_cost_more(three_groups):
    one = kmeans.fit_kmeans(three_groups, FEATURES, 6, n_init=1).cost
    assert kmeans.fit_kmeans(three_groups, FEATURES, 6, n_init=4).cost <= one + 1e-9


def test_flat_and_arrow_assignment_agree(spark, three_groups):
    rng = np.random.RandomState(0)
    centers = rng.randn(7, 5).tolist()
    centers.append(centers[2])
    vec = three_groups.withColumn("v", F.array(*FEATURES))
    a = kmeans.assign_nearest(vec, FEATURES, centers, "a", "da")
    b = kmeans.assign_nearest(a, "v", centers, "b", "db")
    assert b.where("a <> b or abs(da - db) > 1e-12").count() == 0


def test_auto_k(spark):
    pdf = shifted([slice(0, 30), slice(30, 60), slice(60, 100)], by=12.0)
    best, scores = kmeans.find_optimal_k(spark.createDataFrame(pdf), FEATURES, 5, n_init=2)
    assert best == 3
    rows = scores.collect()
    assert [r.k for r in rows] == [2, 3, 4, 5] and max(r.silhouette for r in rows) > 0
    assert [r.k for r in rows if r.is_best] == [3]
    best, _ = kmeans.find_optimal_k(
        spark.createDataFrame(pdf), FEATURES, 4, n_init=1, silhouette="squared"
    )
    assert best == 3


def test_errors(three_groups):
    with pytest.raises(ValueError, match="algorithm"):
        fit_clusters(three_groups, FEATURES, algorithm="nope")
    with pytest.raises(ValueError, match="fit first"):
        kmeans.assign_nearest(three_groups, FEATURES, [])
    with pytest.raises(ValueError, match="No valid clustering"):
        kmeans.find_optimal_k(three_groups.limit(1), FEATURES, 3, n_init=1)


def _silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("plan", [{}, {"max_broadcast_rows": 5, "tile_rows": 20}])
def test_silhouette_with_copies_and_singletons(spark, plan):
    rng = np.random.RandomState(3)
    x = np.concatenate([rng.randn(40, 2), np.repeat(rng.randn(2, 2) + 3, 25, 0), [[9.0, 9.0]]])
    lab = np.r_[rng.randint(0, 3, 90), 7]
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(cluster=lab)
    got = quality.silhouette(spark.createDataFrame(pdf), ["a", "b"], **plan).first()[0]
    assert abs(got - _silhouette(x, lab)) < 1e-9


def test_quality_scores(spark):
    pdf = shifted([slice(0, 50), slice(50, 100)])
    pdf["cluster"] = np.r_[np.zeros(50, int), np.ones(50, int)]
    r = quality.clustering_quality(spark.createDataFrame(pdf), FEATURES).first()
    assert min(r) > 0
    x, lab = pdf[FEATURES].values, pdf.cluster.values
    assert abs(r.silhouette - _silhouette(x, lab)) < 1e-9
    mu = x.mean(0)
    c = np.array([x[lab == k].mean(0) for k in (0, 1)])
    b = sum(50 * ((c[k] - mu) ** 2).sum() for k in (0, 1))
    w = sum(((x[lab == k] - c[k]) ** 2).sum() for k in (0, 1))
    assert abs(r.calinski_harabasz - b * 98 / w) < 1e-9
    s = [np.sqrt(((x[lab == k] - c[k]) ** 2).sum(1)).mean() for k in (0, 1)]
    assert abs(r.davies_bouldin - sum(s) / np.sqrt(((c[0] - c[1]) ** 2).sum())) < 1e-9


def test_distributed_score_plans_agree(spark, monkeypatch):
    pdf = shifted([slice(0, 50), slice(50, 100)])
    pdf["cluster"] = np.arange(100) % 7
    df = spark.createDataFrame(pdf)
    small = quality.clustering_quality(df, FEATURES).first()
    monkeypatch.setattr(quality, "SMALL_K", 2)
    assert abs(quality.calinski_harabasz(df, FEATURES).first()[0] - small[1]) < 1e-9
    assert abs(quality.davies_bouldin(df, FEATURES, chunk=3).first()[0] - small[2]) < 1e-9


def test_quality_one_label(three_groups):
    one = three_groups.withColumn("cluster", F.lit(0))
    assert tuple(quality.clustering_quality(one, FEATURES).first()) == (-1.0, 0.0, float("inf"))


def _dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, lab, c = near.sum(1) >= m, np.full(len(x), -1), 0
    for i in range(len(x)):
        if lab[i] != -1 or not core[i]:
            continue
        todo, lab[i] = [i], c
        while todo:
            j = todo.pop()
            if core[j]:
                new = [q for q in np.flatnonzero(near[j]) if lab[q] == -1]
                lab[new] = c
                todo += new
        c += 1
    return core, lab


@pytest.mark.parametrize(
    "d,eps,m,plan",
    [
        (2, 0.15, 5, {}),
        (2, 0.15, 5, {"salt_rows": 4, "direct_pairs": 10}),
        (5, 0.6, 5, {}),
    ],
)
def test_dbscan_matches_brute_force(spark, d, eps, m, plan):
    rng = np.random.default_rng(0)
    x = np.concatenate(
        [
            rng.normal(0, 0.3, (200, d)),
            rng.normal(2, 0.2, (150, d)),
            rng.uniform(-3, 4, (100, d)),
            np.repeat(rng.normal(1, 0.1, (2, d)), 60, 0),
        ]
    ).round(3)
    names = [f"f{i}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=names).assign(id=np.arange(len(x)))
    core, lab = _dbscan(x, eps, m)
    out = dbscan(spark.createDataFrame(pdf), "id", names, eps, m, **plan).toPandas()
    assert (out.sort_values("id").cluster.values == lab).all()
    if not plan:
        flags = core_points(spark.createDataFrame(pdf), "id", names, eps, m).toPandas()
        assert (flags.sort_values("id").is_core.values == core).all()


def test_dbscan_all_noise(spark):
    df = spark.createDataFrame([(i, 100.0 * i) for i in range(10)], "id long, x double")
    model, out = fit_clusters(df, ["x"], algorithm="dbscan", id_col="id")
    assert {r.cluster for r in out.collect()} == {-1} and model.n_clusters == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_components_and_numbers(spark, small):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 100)] + [(7, 300 + i) for i in range(50)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), small_edges=small).collect()
    assert len(out) == 41 + 3 + 50
    assert all(r.component == (100 if r.node in (100, 101, 102) else 0) for r in out)
    nums = dense_number(spark.range(0, 1000, 3, 7).withColumnRenamed("id", "v"), "v", "n", small).collect()
    assert len(nums) == 334 and all(r.n == r.v // 3 for r in nums)


def _ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = x[groups[i]], x[groups[j]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, i, j)
        _, i, j = best
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_ward_is_exact_on_small_tables(spark):
    pdf = shifted([slice(0, 15), slice(15, 30)], n=40)
    out = hierarchy.hierarchical(spark.createDataFrame(pdf), FEATURES, 4, method="exact").toPandas()
    got = {frozenset(g.id) for _, g in out.groupby("cluster")}
    assert got == _ward(pdf[FEATURES].values, 4)


def test_ward_over_micro_clusters(spark):
    pdf = shifted([slice(0, 30), slice(30, 60), slice(60, 100)], by=15.0)
    out = hierarchy.hierarchical(spark.createDataFrame(pdf), FEATURES, 3, leaves=20).toPandas()
    got = {frozenset(g.id) for _, g in out.groupby("cluster")}
    assert got == {frozenset(range(30)), frozenset(range(30, 60)), frozenset(range(60, 100))}


def test_pca_matches_numpy(spark, three_groups):
    fit = pca.fit_pca(three_groups, FEATURES)
    x = three_groups.orderBy("id").toPandas()[FEATURES].values
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(5), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(fit.components, vt[:2], atol=1e-8)
    assert np.allclose(fit.explained_variance_ratio, (s**2 / (s**2).sum())[:2])
    out = pca.project(three_groups, FEATURES, fit).orderBy("id").toPandas()
    assert np.allclose(out[["x", "y"]].values, xc @ vt[:2].T, atol=1e-8)


def test_noise_and_shared_names(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0), (1, 0, 3.0), (2, 1, 5.0), (3, -1, 100.0)], "id int, cluster int, v double"
    )
    stats = {r.cluster_id: r for r in clusters.cluster_stats(df, ["v"]).collect()}
    assert set(stats) == {0, 1}
    assert stats[0].percentage == 50.0 and stats[0].std_features == [1.0]
    moods = spark.createDataFrame([(0, "same"), (1, "same")], "cluster_id int, mood string")
    heat = report.cluster_heatmap(df, ["v"], moods).collect()
    assert {(r.cluster, r.mood, r["mean"]) for r in heat} == {(0, "same", 2.0), (1, "same", 5.0)}
    named = clusters.attach_moods(df, moods)
    boxes = {r.mood: r for r in report.boxplot_stats(named, ["v"]).collect()}
    assert set(boxes) == {"same", "Cluster -1"} and boxes["same"].n == 3
    with pytest.raises(ValueError, match="Cluster 5 not found"):
        clusters.cluster_info(clusters.cluster_stats(df, ["v"]), moods, 5)
    totals = clusters.overview_totals(df).first()
    assert tuple(totals) == (4, 2)


def test_mood_rules(spark):
    cases = [
        ((0.1, 0.8, 0.7), "Energetic & Happy"),
        ((0.1, 0.8, 0.3), "Energetic & Intense"),
        ((0.1, 0.3, 0.7), "Calm & Peaceful"),
        ((0.9, 0.3, 0.3), "Melancholic & Sad"),
        ((0.8, 0.5, 0.5), "Danceable & Upbeat"),
        ((0.7, 0.6, 0.55), "Moderate & Balanced"),
        ((0.7, 0.7, 0.5), "Ambient & Atmospheric"),
    ]
    stats = spark.createDataFrame(
        [(i, list(m)) for i, (m, _) in enumerate(cases)], "cluster_id int, mean_features array<double>"
    )
    got = {r.cluster_id: r.mood for r in clusters.mood_labels(stats).collect()}
    assert [got[i] for i in range(len(cases))] == [name for _, name in cases]
    short = spark.createDataFrame([(0, [0.8])], "cluster_id int, mean_features array<double>")
    assert clusters.mood_labels(short).first().mood == "Melancholic & Sad"
