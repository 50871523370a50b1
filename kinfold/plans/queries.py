"""Registered queries: every operator over the driver tables, next to the same result in SQL.

Adapters give the tables the shape the operators expect: a key, numeric features, a label.
Both engines round doubles to six places, which is all the comparison needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    display_label,
    percent_text,
    similarity,
    title_case,
    whole_seconds,
)
from ..operators import (
    clean,
    clustering,
    clusters,
    dbscan,
    describe,
    hierarchy,
    kmeans,
    pca,
    quality,
    recommend,
    report,
    sample,
    search,
)
from ..operators.inverted import build_inverted, choose_probes, knn_inverted as look_up
from ..operators.knn import knn
from ..sources import nested

DIMS = 64
E_FEATURES = [f"f{i}" for i in range(DIMS)]
V_FEATURES = ["value", "k", "hour"]
L_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Labels of the event types, alphabetical.
EVENT_LABELS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
EPS, MIN_SAMPLES = 0.06, 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


# --- rounding, the same in both engines ------------------------------------


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c, 6))


def s6(expr: str) -> str:
    return f"CASE WHEN abs({expr}) < 5e-7 THEN 0.0::DOUBLE ELSE round({expr}, 6) END"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# --- adapters ----------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("cluster"),
    )


def events(spark, d) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv])
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
        F.when(
            F.col("event_id") % 13 != 5, F.get_json_object("props", "$.k").cast("double")
        ).alias("k"),
        F.hour("ts").alias("hour"),
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        label[F.col("event_type")].alias("cluster"),
    )


def lines(spark, d) -> DataFrame:
    """Line items with three axes in [0, 1] for naming, labelled by order."""
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        ((F.col("l_quantity") - 1) / 49.0).alias("danceability"),
        (F.col("l_discount") / 0.1).alias("energy"),
        (F.col("l_tax") / 0.08).alias("valence"),
    )


def line_moods(spark, d) -> DataFrame:
    axes = [F.col(c) for c in ("danceability", "energy", "valence")]
    return clusters.mood_labels_by_axes(lines(spark, d), *axes, cluster="l_orderkey", digits=6)


def event_moods(spark, d) -> DataFrame:
    """Names of four of the five event labels; the last is left without one on purpose."""
    named = clusters.mood_labels_by_axes(
        events(spark, d), F.col("hour") / 23.0, F.col("k") / 99.0, F.col("value") / 100.0, digits=6
    )
    return named.where("cluster_id < 4").select("cluster_id", "mood")


def label_centres(spark, d) -> DataFrame:
    """Mean vector per label, as vectors to ask about."""
    return clusters.cluster_stats(embeddings(spark, d), "embedding").select(
        "cluster_id", F.col("mean_features").alias("embedding")
    )


def scaled_events(spark, d) -> DataFrame:
    ev = table(spark, d, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    return clean.scale(ev, ["value", "k"], "standard")


E_SQL = (
    "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS cluster FROM embeddings)"
)
V_SQL = """v AS (SELECT event_id,
    CASE WHEN event_id % 17 <> 0 THEN value END AS value,
    CASE WHEN event_id % 13 <> 5 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
    CAST(hour(ts) AS INTEGER) AS hour,
    CAST(event_type = 'error' AS INTEGER) AS is_error,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
         WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS cluster
  FROM events)"""
L_SQL = """l AS (SELECT l_orderkey, l_linenumber, (l_quantity - 1) / 49.0::DOUBLE AS danceability,
    l_discount / 0.1::DOUBLE AS energy, l_tax / 0.08::DOUBLE AS valence FROM lineitem)"""


def mood_case(d: str, e: str, v: str) -> str:
    return f"""CASE WHEN {e} > 0.7 AND {v} > 0.6 THEN 'Energetic & Happy'
      WHEN {e} > 0.7 AND {v} < 0.4 THEN 'Energetic & Intense'
      WHEN {e} < 0.4 AND {v} > 0.6 THEN 'Calm & Peaceful'
      WHEN {e} < 0.4 AND {v} < 0.4 THEN 'Melancholic & Sad'
      WHEN {d} > 0.7 THEN 'Danceable & Upbeat'
      WHEN {e} > 0.5 AND {v} > 0.5 THEN 'Moderate & Balanced'
      ELSE 'Ambient & Atmospheric' END"""


LM_SQL = f"""lm AS (SELECT *, {mood_case('danceability', 'energy', 'valence')} AS mood FROM (
    SELECT l_orderkey AS cluster_id, round(avg(danceability), 6) AS danceability,
           round(avg(energy), 6) AS energy, round(avg(valence), 6) AS valence
    FROM l GROUP BY l_orderkey))"""
VM_SQL = f"""vm AS (SELECT cluster_id, {mood_case('d', 'e', 'v')} AS mood FROM (
    SELECT cluster AS cluster_id, round(avg(hour / 23.0::DOUBLE), 6) AS d,
           round(avg(k / 99.0::DOUBLE), 6) AS e, round(avg(value / 100.0::DOUBLE), 6) AS v
    FROM v GROUP BY cluster) WHERE cluster_id < 4)"""
STATS_SQL = """j AS (SELECT cluster, i - 1 AS j, v[i] AS x FROM e, range(1, 65) AS r(i)),
  s AS (SELECT CAST(cluster AS INTEGER) AS cluster_id, j, count(*) AS size, avg(x) AS mean,
               stddev_pop(x) AS std FROM j GROUP BY cluster, j)"""


# --- projections, search, head -----------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem"
)
def feature_projection(spark, d):
    wanted = ["l_quantity", "not_in_the_table", "l_discount", "l_tax"]
    return clean.project_features(
        table(spark, d, "lineitem"), wanted, keep=["l_orderkey", "l_linenumber"]
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(spark, d):
    cols = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return search.head(cols, "o_orderkey", 10)


@query("""
SELECT p_partkey, CAST(floor(round(p_retailprice * 100) / 1000) AS BIGINT) AS seconds,
       coalesce(p_name, 'Unknown') || ' - ' || coalesce(p_brand, 'Unknown') AS label,
       printf('%.1f%%', p_retailprice / 10 + 0.01) AS percent,
       upper(p_type[1]) || lower(p_type[2:]) AS title
FROM part
""")
def display_projection(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        whole_seconds(F.round(F.col("p_retailprice") * 100)).alias("seconds"),
        display_label([F.col("p_name"), F.col("p_brand")]).alias("label"),
        percent_text(F.col("p_retailprice") / 10 + 0.01).alias("percent"),
        title_case(F.col("p_type")).alias("title"),
    )


@query("""
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE coalesce(regexp_matches(p_name, 'WID.ET$', 'i'), false)
   OR coalesce(regexp_matches(p_brand, 'WID.ET$', 'i'), false)
   OR coalesce(regexp_matches(p_type, 'WID.ET$', 'i'), false)
ORDER BY p_partkey LIMIT 20
""")
def text_search(spark, d):
    cols = ["p_name", "p_brand", "p_type"]
    part = table(spark, d, "part").select("p_partkey", *cols)
    return search.text_search(part, "WID.ET$", cols, "p_partkey")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part ORDER BY p_partkey LIMIT 10")
def text_search_empty(spark, d):
    cols = ["p_name", "p_brand", "p_type"]
    part = table(spark, d, "part").select("p_partkey", *cols)
    return search.text_search(part, "", cols, "p_partkey")


# --- cleaning and scaling ------------------------------------------------------


_IQR_SQL = f"""WITH {V_SQL},
b AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3,
             quantile_cont(k, 0.25) AS k1, quantile_cont(k, 0.75) AS k3,
             quantile_cont(hour::DOUBLE, 0.25) AS h1, quantile_cont(hour::DOUBLE, 0.75) AS h3
      FROM v),
f AS (SELECT v.*, coalesce(value < v1 - 1.5 * (v3 - v1) OR value > v3 + 1.5 * (v3 - v1), false)
          OR coalesce(k < k1 - 1.5 * (k3 - k1) OR k > k3 + 1.5 * (k3 - k1), false)
          OR coalesce(hour < h1 - 1.5 * (h3 - h1) OR hour > h3 + 1.5 * (h3 - h1), false) AS out
      FROM v, b)"""


@query(_IQR_SQL + " SELECT event_id, value, k, hour FROM f WHERE NOT out")
def outlier_iqr(spark, d):
    rows = clean.remove_outliers(events(spark, d), V_FEATURES)
    return rows.select("event_id", "value", "k", "hour")


@query(f"""WITH {V_SQL},
b AS (SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(k) AS km, stddev_samp(k) AS ks,
             avg(hour) AS hm, stddev_samp(hour) AS hs FROM v)
SELECT event_id, value, k, hour FROM v, b
WHERE NOT (coalesce(abs((value - vm) / vs) > 1.5, false) OR coalesce(abs((k - km) / ks) > 1.5, false)
           OR coalesce(abs((hour - hm) / nullif(hs, 0)) > 1.5, false))
""")
def outlier_zscore(spark, d):
    rows = clean.remove_outliers(events(spark, d), V_FEATURES, method="zscore")
    return rows.select("event_id", "value", "k", "hour")


@query(_IQR_SQL + f"""
SELECT count(*) AS n_rows, CAST(sum(out::INTEGER) AS BIGINT) AS n_outliers,
       {s6('sum(out::INTEGER) * 100.0::DOUBLE / count(*)')} AS outlier_percent FROM f""")
def outlier_report(spark, d):
    out = clean.outlier_report(events(spark, d), V_FEATURES)
    return rounded(out, "outlier_percent")


@query(f"""WITH {V_SQL}
SELECT event_id, {s6('sin(2 * pi() * hour / 24.0::DOUBLE)')} AS hour_sin,
       {s6('cos(2 * pi() * hour / 24.0::DOUBLE)')} AS hour_cos FROM v""")
def circular_encode(spark, d):
    out = clean.circular_encode(events(spark, d).select("event_id", "hour"), "hour", 24)
    return rounded(out, "hour_sin", "hour_cos")


@query(f"""WITH {V_SQL}
SELECT event_id, 0.0::DOUBLE AS is_error_sin,
       CASE WHEN is_error = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS is_error_cos FROM v""")
def circular_encode_binary(spark, d):
    out = clean.circular_encode(events(spark, d).select("event_id", "is_error"), "is_error", 2)
    return rounded(out, "is_error_sin", "is_error_cos")


@query(f"""WITH {V_SQL}, m AS (SELECT median(value) AS mv, median(k) AS mk FROM v)
SELECT event_id, {s6('coalesce(value, mv)')} AS value, {s6('coalesce(k, mk)')} AS k FROM v, m""")
def impute_median(spark, d):
    out = clean.impute_median(events(spark, d).select("event_id", "value", "k"), ["value", "k"])
    return rounded(out, "value", "k")


def _scaled(spark, d, kind):
    out = clean.scale(events(spark, d).select("event_id", "value", "k"), ["value", "k"], kind)
    return rounded(out, "value", "k")


@query(f"""WITH {V_SQL}, m AS (SELECT avg(value) AS a, stddev_pop(value) AS b, avg(k) AS c,
  stddev_pop(k) AS g FROM v)
SELECT event_id, {s6('(value - a) / b')} AS value, {s6('(k - c) / g')} AS k FROM v, m""")
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query(f"""WITH {V_SQL}, m AS (SELECT min(value) AS a, max(value) AS b, min(k) AS c, max(k) AS g
  FROM v)
SELECT event_id, {s6('(value - a) / (b - a)')} AS value, {s6('(k - c) / (g - c)')} AS k FROM v, m""")
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query(f"""WITH {V_SQL}, m AS (SELECT median(value) AS a,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS b, median(k) AS c,
  quantile_cont(k, 0.75) - quantile_cont(k, 0.25) AS g FROM v)
SELECT event_id, {s6('(value - a) / b')} AS value, {s6('(k - c) / g')} AS k FROM v, m""")
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


def _processor() -> clean.FeatureProcessor:
    return clean.FeatureProcessor(
        features=["value", "k", "is_error", "hour"], periods={"hour": 24, "is_error": 2}
    )


_PREP_COLS = ["value", "k", "hour_sin", "hour_cos", "is_error_sin", "is_error_cos"]
_PREP_SQL = f"""WITH {V_SQL},
b AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3,
             quantile_cont(k, 0.25) AS k1, quantile_cont(k, 0.75) AS k3,
             quantile_cont(hour::DOUBLE, 0.25) AS h1, quantile_cont(hour::DOUBLE, 0.75) AS h3,
             quantile_cont(is_error::DOUBLE, 0.25) AS e1, quantile_cont(is_error::DOUBLE, 0.75) AS e3
      FROM v),
enc AS (SELECT event_id, value, k,
    CASE WHEN abs(sin(2 * pi() * hour / 24.0::DOUBLE)) < 1e-12 THEN 0 ELSE sin(2 * pi() * hour / 24.0::DOUBLE) END AS hour_sin,
    CASE WHEN abs(cos(2 * pi() * hour / 24.0::DOUBLE)) < 1e-12 THEN 0 ELSE cos(2 * pi() * hour / 24.0::DOUBLE) END AS hour_cos,
    0.0::DOUBLE AS is_error_sin, CASE WHEN is_error = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS is_error_cos,
    coalesce(value < v1 - 1.5 * (v3 - v1) OR value > v3 + 1.5 * (v3 - v1), false)
      OR coalesce(k < k1 - 1.5 * (k3 - k1) OR k > k3 + 1.5 * (k3 - k1), false)
      OR coalesce(hour < h1 - 1.5 * (h3 - h1) OR hour > h3 + 1.5 * (h3 - h1), false)
      OR coalesce(is_error < e1 - 1.5 * (e3 - e1) OR is_error > e3 + 1.5 * (e3 - e1), false) AS out
  FROM v, b),
kept AS (SELECT * FROM enc WHERE NOT out),
med AS (SELECT {', '.join(f'median({c}) AS md_{c}' for c in _PREP_COLS)} FROM kept),
par AS (SELECT {', '.join(
    f'avg(coalesce({c}, md_{c})) AS m_{c}, stddev_pop(coalesce({c}, md_{c})) AS s_{c}'
    for c in _PREP_COLS)} FROM kept, med)"""


def _prep_select(source: str) -> str:
    cols = ", ".join(
        s6(
            f"((coalesce({c}, md_{c}) - m_{c}) / CASE WHEN s_{c} < 1e-12 THEN 1 ELSE s_{c} END)"
        )
        + f" AS {c}"
        for c in _PREP_COLS
    )
    return f"{_PREP_SQL} SELECT event_id, {cols} FROM {source}, med, par"


@query(_prep_select("kept"))
def prepare_features(spark, d):
    _, out = _processor().fit_transform(events(spark, d))
    return rounded(out.select("event_id", *_PREP_COLS), *_PREP_COLS)


@query(_prep_select("enc"))
def transform_new(spark, d):
    fitted, _ = _processor().fit_transform(events(spark, d))
    out = fitted.transform(events(spark, d))
    return rounded(out.select("event_id", *_PREP_COLS), *_PREP_COLS)


# --- descriptions ----------------------------------------------------------------


def _per_feature(names, make, source) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {make(c)} FROM {source}" for c in names)


@query(f"WITH {V_SQL} " + _per_feature(V_FEATURES, lambda c: f"""count(*) AS n_rows,
  {s6(f'avg({c})')} AS mean, {s6(f'stddev_samp({c})')} AS std, {s6(f'min({c})::DOUBLE')} AS min,
  {s6(f'max({c})::DOUBLE')} AS max, count(*) - count({c}) AS missing""", "v"))
def feature_summary(spark, d):
    out = describe.feature_summary(events(spark, d), [*V_FEATURES, "not_in_the_table"])
    return rounded(out, "mean", "std", "min", "max")


@query(f"WITH {V_SQL} " + _per_feature(V_FEATURES, lambda c: f"count(*) - count({c}) AS missing", "v"))
def missing_counts(spark, d):
    return describe.missing_counts(events(spark, d), V_FEATURES)


@query(f"WITH {V_SQL} SELECT * FROM ("
       + _per_feature(V_FEATURES, lambda c: f"count(*) - count({c}) AS missing", "v")
       + ") WHERE missing > 0")
def missing_only(spark, d):
    return describe.missing_counts(events(spark, d), V_FEATURES, only_missing=True)


@query(f"WITH {V_SQL} SELECT CAST(sum(missing) AS BIGINT) AS missing FROM ("
       + _per_feature(V_FEATURES, lambda c: f"count(*) - count({c}) AS missing", "v") + ")")
def missing_total(spark, d):
    return describe.missing_total(events(spark, d), V_FEATURES)


@query(f"WITH {V_SQL} " + _per_feature(V_FEATURES, lambda c: f"""count({c}) AS count,
  {s6(f'avg({c})')} AS mean, {s6(f'stddev_samp({c})')} AS std, {s6(f'min({c})::DOUBLE')} AS min,
  {s6(f'max({c})::DOUBLE')} AS max, {s6(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25,
  {s6(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50,
  {s6(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75""", "v"))
def describe_features(spark, d):
    out = describe.describe(events(spark, d), V_FEATURES)
    return rounded(out, "mean", "std", "min", "max", "p25", "p50", "p75")


_INFO = [("event_id", "bigint"), ("value", "double"), ("k", "double"), ("hour", "int"),
         ("is_error", "int"), ("cluster", "int")]


@query(f"WITH {V_SQL} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, "
    f"count(*) AS n_rows FROM v" for i, (c, t) in enumerate(_INFO)))
def table_info(spark, d):
    return describe.table_info(events(spark, d))


@query("""SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS n_distinct FROM events
UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'props', count(DISTINCT props) FROM events""")
def distinct_counts(spark, d):
    return describe.distinct_counts(table(spark, d, "events"), ["event_type", "user_id", "props"])


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {s6(f'corr({a}, {b})')} AS correlation "
    f"FROM lineitem" for a in L_FEATURES for b in L_FEATURES))
def correlation_matrix(spark, d):
    return rounded(describe.correlation_matrix(table(spark, d, "lineitem"), L_FEATURES), "correlation")


@query("WITH " + ", ".join(f"""b{i} AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem),
h{i} AS (SELECT least(floor(({c} - lo) / ((hi - lo) / 50)) + 1, 50)::INTEGER AS bin, count(*) AS n
         FROM lineitem, b{i} GROUP BY 1)""" for i, c in enumerate(L_FEATURES)) + " "
       + " UNION ALL ".join(f"""SELECT '{c}' AS feature, r.bin::INTEGER AS bin,
  {s6('lo + (r.bin - 1) * (hi - lo) / 50')} AS bin_low, {s6('lo + r.bin * (hi - lo) / 50')} AS bin_high,
  coalesce(n, 0) AS n FROM range(1, 51) AS r(bin) CROSS JOIN b{i} LEFT JOIN h{i} ON h{i}.bin = r.bin"""
                            for i, c in enumerate(L_FEATURES)))
def histogram_50(spark, d):
    out = describe.histogram(table(spark, d, "lineitem"), L_FEATURES, 50)
    return rounded(out, "bin_low", "bin_high")


# --- nearest neighbours and recommendations -----------------------------------------


def _pairs(distance: str = "list_distance(a.v, b.v)", on: str = "") -> str:
    return f"""{E_SQL}, p AS (SELECT a.vec_id AS query_id, b.vec_id, a.cluster AS own,
    b.cluster AS other, {distance} AS distance FROM e a, e b {on}),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rk FROM p)"""


def _knn_sql(distance: str) -> str:
    return f"""WITH {_pairs(distance)} SELECT query_id, vec_id, {s6('distance')} AS distance,
  rk::INTEGER AS rank FROM n WHERE rk <= 21"""


def _knn(spark, d, metric, p=2.0):
    out = knn(embeddings(spark, d), id_col="vec_id", features="embedding", metric=metric, p=p)
    return rounded(out, "distance")


@query(_knn_sql("list_distance(a.v, b.v)"))
def knn_euclidean(spark, d):
    return _knn(spark, d, "euclidean")


@query(_knn_sql("list_cosine_distance(a.v, b.v)"))
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))"
_L3 = "pow(list_sum(list_transform(range(1, 65), lambda i: pow(abs(a.v[i] - b.v[i]), 3))), 1.0 / 3)"


@query(_knn_sql(_L1))
def knn_manhattan(spark, d):
    return _knn(spark, d, "manhattan")


@query(_knn_sql(_L3))
def knn_minkowski_p3(spark, d):
    return _knn(spark, d, "minkowski", 3.0)


@query(_knn_sql("list_distance(a.v, b.v)"))
def knn_tiles(spark, d):
    """The plan for any number of queries, whatever the table's size."""
    out = knn(
        embeddings(spark, d), id_col="vec_id", features="embedding", max_broadcast_queries=0, block_rows=256
    )
    return rounded(out, "distance")


@query(_knn_sql("list_distance(a.v, b.v)"))
def knn_inverted_full(spark, d):
    """The inverted file with every cell probed, which is exact."""
    rows = embeddings(spark, d)
    index = build_inverted(rows, id_col="vec_id", features="embedding")
    out = look_up(index, rows, id_col="vec_id", features="embedding", probes=index.cells)
    return rounded(out, "distance")


@query()
def knn_inverted(spark, d):
    """Every 50th row asks all rows, through as many cells as a sample needs; tests measure the recall."""
    rows = embeddings(spark, d)
    index = build_inverted(rows, id_col="vec_id", features="embedding")
    probes = choose_probes(index, rows, id_col="vec_id", features="embedding")
    out = look_up(index, rows.where("vec_id % 50 = 0"), id_col="vec_id", features="embedding", probes=probes)
    return rounded(out, "distance")


_REC_COLS = ["query_id", "vec_id", "rank", "distance", "similarity_score"]


def _recs(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.select(*_REC_COLS, *more), "distance", "similarity_score")


def _similar(spark, d, mode):
    return recommend.similar(
        embeddings(spark, d), id_col="vec_id", features="embedding", mode=mode
    )


def _rec_sql(source: str, n: int, extra: str = "") -> str:
    return f"""SELECT query_id, vec_id, rank, {s6('distance')} AS distance,
  {s6('1 / (1 + distance)')} AS similarity_score FROM (
    SELECT query_id, vec_id, distance, (row_number() OVER (PARTITION BY query_id
      ORDER BY distance, vec_id))::INTEGER AS rank FROM {source}) WHERE rank <= {n} {extra}"""


_POST = "n WHERE rk <= 21 AND own = other AND query_id <> vec_id"


@query(f"WITH {_pairs()} {_rec_sql(_POST, 10)}")
def similar_postfilter(spark, d):
    return _recs(_similar(spark, d, "postfilter"))


@query(f"WITH e0 AS (SELECT vec_id // 2 AS vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS cluster, "
       f"row_number() OVER (PARTITION BY vec_id // 2 ORDER BY vec_id) AS nth FROM embeddings), "
       f"e AS (SELECT * FROM e0 WHERE nth = 1), {_pairs().removeprefix(E_SQL + ', ')} {_rec_sql(_POST, 10)}")
def similar_repeated_ids(spark, d):
    """Two rows under each id, of which the first counts."""
    rows = embeddings(spark, d).withColumn("nth", F.col("vec_id")).withColumn("vec_id", F.expr("vec_id div 2"))
    return _recs(recommend.similar(rows, id_col="vec_id", features="embedding", row_order="nth"))


@query(f"WITH {_pairs()} {_rec_sql('n WHERE rk <= 21 AND query_id <> vec_id', 10)}")
def similar_any_cluster(spark, d):
    return _recs(_similar(spark, d, "any"))


@query(f"WITH {_pairs(on='WHERE a.cluster = b.cluster')} "
       f"{_rec_sql('n WHERE rk <= 11 AND query_id <> vec_id', 10)}")
def similar_prefilter(spark, d):
    return _recs(_similar(spark, d, "prefilter"))


_CENTRE_SQL = """c AS (SELECT cluster AS cluster_id, list(m ORDER BY j) AS v FROM (
    SELECT cluster, i - 1 AS j, avg(v[i]) AS m FROM e, range(1, 65) AS r(i) GROUP BY cluster, i)
  GROUP BY cluster)"""


@query(f"""WITH {E_SQL}, {_CENTRE_SQL},
p AS (SELECT c.cluster_id AS query_id, e.vec_id, list_distance(c.v, e.v) AS distance FROM c, e),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rk FROM p)
{_rec_sql('n WHERE rk <= 21', 10)}""")
def similar_to_vector(spark, d):
    out = recommend.similar_to_vectors(
        embeddings(spark, d), label_centres(spark, d), id_col="vec_id", features="embedding",
        vector_id="cluster_id",
    )
    return _recs(out)


@query(f"""WITH {E_SQL}, {_CENTRE_SQL},
p AS (SELECT c.cluster_id AS query_id, e.vec_id, e.cluster AS other,
             list_distance(c.v, e.v) AS distance FROM c, e),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rk FROM p)
{_rec_sql('n WHERE rk <= 21 AND other = query_id', 10)}""")
def similar_to_vector_in_cluster(spark, d):
    centres = label_centres(spark, d).withColumn("wanted", F.col("cluster_id"))
    out = recommend.similar_to_vectors(
        embeddings(spark, d), centres, id_col="vec_id", features="embedding",
        vector_id="cluster_id", cluster="cluster", wanted_cluster="wanted",
    )
    return _recs(out)


_HASH = "md5(vec_id::VARCHAR || '#42')"


def _by_cluster_sql(source: str, n: int) -> str:
    return f"""SELECT vec_id, cluster, 1.0::DOUBLE AS similarity_score, 0.0::DOUBLE AS distance FROM (
  SELECT vec_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY {_HASH}, vec_id) AS rk
  FROM {source}) WHERE rk <= {n}"""


@query(f"WITH {E_SQL} {_by_cluster_sql('e', 20)}")
def recommend_by_cluster(spark, d):
    rows = embeddings(spark, d).select("vec_id", "cluster")
    return recommend.recommend_by_cluster(rows, id_col="vec_id")


@query(f"""WITH {E_SQL}, x AS (SELECT * FROM e
  WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) {_by_cluster_sql('x', 20)}""")
def recommend_by_cluster_excluding(spark, d):
    rows = embeddings(spark, d).select("vec_id", "cluster")
    bad = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return recommend.recommend_by_cluster(rows, id_col="vec_id", exclude=bad)


@query(f"SELECT vec_id, label FROM embeddings ORDER BY {_HASH}, vec_id LIMIT 10")
def sample_n(spark, d):
    return sample.sample_n(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 10)


@query(f"""SELECT vec_id, label FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_HASH}, vec_id) = 1""")
def sample_per_cluster(spark, d):
    return sample.sample_per_group(
        table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label"
    )


@query(f"""WITH {_pairs()}, r AS ({_rec_sql(_POST, 10).replace(s6('distance'), 'distance').replace(
    s6('1 / (1 + distance)'), '1 / (1 + distance)')})
SELECT query_id, count(*) AS n_recommendations, {s6('avg(similarity_score)')} AS avg_similarity,
  {s6('min(similarity_score)')} AS min_similarity, {s6('max(similarity_score)')} AS max_similarity,
  {s6('avg(distance)')} AS avg_distance, {s6('min(distance)')} AS min_distance,
  {s6('max(distance)')} AS max_distance FROM r GROUP BY query_id""")
def recommendation_summary(spark, d):
    out = recommend.recommendation_summary(_similar(spark, d, "postfilter"), by=["query_id"])
    return rounded(out, *[c for c in out.columns if c not in ("query_id", "n_recommendations")])


@query(f"""WITH {_pairs()}, q AS (SELECT vec_id FROM embeddings ORDER BY {_HASH}, vec_id LIMIT 3)
{_rec_sql(_POST + ' AND query_id IN (SELECT vec_id FROM q)', 3)}""")
def batch_recommend(spark, d):
    out = recommend.batch_recommend(
        embeddings(spark, d), id_col="vec_id", features="embedding"
    )
    return _recs(out)


@query(f"""WITH {_pairs()}, r AS (SELECT query_id, vec_id, rank FROM (
  {_rec_sql('n WHERE rk <= 21 AND query_id <> vec_id', 5)})),
w AS (SELECT query_id, rank AS series, vec_id FROM r
      UNION ALL SELECT DISTINCT query_id, 0 AS series, query_id AS vec_id FROM r)
SELECT query_id, series, CASE WHEN series = 0 THEN 'Query Track' ELSE w.vec_id::VARCHAR END AS series_name,
  'f' || (i - 1) AS feature, {s6('coalesce(e.v[i], 0)')} AS value
FROM w JOIN e ON e.vec_id = w.vec_id, range(1, 65) AS t(i)""")
def compare_recommendations(spark, d):
    shown = E_FEATURES
    raw = embeddings(spark, d).select(
        "vec_id", *[F.col("embedding")[i].alias(f) for i, f in enumerate(shown)]
    )
    out = report.compare_recommendations(raw, _similar(spark, d, "any"), "vec_id", shown)
    return rounded(out, "value")


# --- labelled tables -------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def entity_cluster_lookup(spark, d):
    return search.lookup(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 7)


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def cluster_members(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return clusters.cluster_members(rows, 3, "label")


@query("""SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def align_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, d, "labels")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    return clusters.align_labels(labelled, labels, "doc_id")


@query(f"WITH {L_SQL}, {LM_SQL} SELECT cluster_id, danceability, energy, valence, mood FROM lm")
def mood_label(spark, d):
    return line_moods(spark, d)


@query(f"""WITH {L_SQL}, {LM_SQL} SELECT l.l_orderkey, l.l_linenumber, lm.mood
FROM l JOIN lm ON l.l_orderkey = lm.cluster_id""")
def mood_lookup(spark, d):
    rows = lines(spark, d).select("l_orderkey", "l_linenumber")
    return clusters.attach_moods(rows, line_moods(spark, d), "l_orderkey")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 10 < 8 THEN 0 ELSE l_orderkey END AS cluster FROM lineitem)
SELECT l_orderkey, l_linenumber, cluster, CASE WHEN cluster % 3 = 0 AND o_orderkey IS NOT NULL
  THEN 'name ' || cluster ELSE 'Cluster ' || cluster END AS mood
FROM h LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT 0)
  ON cluster = o_orderkey""")
def mood_lookup_hot(spark, d):
    """Four rows of five in one cluster, and names joined by shuffle."""
    hot = F.when(F.col("l_orderkey") % 10 < 8, F.lit(0).cast("long")).otherwise(F.col("l_orderkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hot.alias("cluster"))
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("cluster_id"))
    ids = ids.unionByName(spark.range(1).select(F.col("id").alias("cluster_id"))).distinct()
    moods = ids.where("cluster_id % 3 = 0").withColumn("mood", F.concat(F.lit("name "), F.col("cluster_id")))
    return clusters.attach_moods(rows, moods, limit=0)


_NAN_SQL = """v AS (SELECT CASE WHEN event_id % 17 <> 0 AND event_id % 11 <> 0 THEN value END AS value,
    CASE WHEN event_id % 13 <> 5 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
    hour(ts)::DOUBLE AS hour FROM events)"""


def _with_nan(spark, d) -> DataFrame:
    """Events whose values are missing as null (ids by 17) or as NaN (ids by 11)."""
    nan = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return events(spark, d).withColumn("value", F.when(F.col("event_id") % 17 != 0, nan))


@query(f"WITH {_NAN_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {s6(f'corr({a}, {b})')} AS correlation FROM v"
    for a in V_FEATURES for b in V_FEATURES))
def correlation_missing(spark, d):
    return rounded(describe.correlation_matrix(_with_nan(spark, d), V_FEATURES), "correlation")


@query(f"""WITH {_NAN_SQL}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM v),
c AS (SELECT least(floor((value - lo) / ((hi - lo) / 20)) + 1, 20)::INTEGER AS bin, count(*) AS n
      FROM v, b WHERE value IS NOT NULL GROUP BY 1)
SELECT 'value' AS feature, i::INTEGER AS bin, {s6('lo + (i - 1) * (hi - lo) / 20')} AS bin_low,
  {s6('lo + i * (hi - lo) / 20')} AS bin_high, coalesce(n, 0)::BIGINT AS n
FROM range(1, 21) AS r(i) CROSS JOIN b LEFT JOIN c ON bin = i""")
def histogram_missing(spark, d):
    return rounded(describe.histogram(_with_nan(spark, d), ["value"], 20), "bin_low", "bin_high")


@query(f"""WITH {V_SQL}, {VM_SQL}
SELECT cluster AS cluster_id, coalesce(any_value(mood), 'Unknown') AS mood, count(*) AS songs,
  printf('%.1f%%', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v)) AS percentage
FROM v LEFT JOIN vm ON cluster = cluster_id GROUP BY cluster""")
def cluster_overview(spark, d):
    stats = clusters.cluster_stats(events(spark, d), V_FEATURES)
    return clusters.cluster_overview(stats, event_moods(spark, d))


@query(f"""WITH {V_SQL} SELECT CAST(count(*) AS BIGINT) AS n_rows,
  count(DISTINCT cluster) AS n_clusters FROM v""")
def overview_totals(spark, d):
    return clusters.overview_totals(events(spark, d))


def _stats_long(stats: DataFrame) -> DataFrame:
    both = F.posexplode(F.arrays_zip("mean_features", "std_features")).alias("j", "ms")
    long = stats.select("cluster_id", "size", "percentage", both).select(
        "cluster_id", "size", "percentage", "j", F.col("ms.mean_features").alias("mean"),
        F.col("ms.std_features").alias("std"),
    )
    return rounded(long, "percentage", "mean", "std")


_STATS_SELECT = f"""SELECT cluster_id, j::INTEGER AS j, size,
  {s6('size * 100.0::DOUBLE / (SELECT count(*) FROM e)')} AS percentage, {s6('mean')} AS mean,
  {s6('std')} AS std FROM s"""


@query(f"WITH {E_SQL}, {STATS_SQL} {_STATS_SELECT}")
def cluster_stats(spark, d):
    return _stats_long(clusters.cluster_stats(embeddings(spark, d), "embedding"))


@query(f"""WITH {E_SQL}, {STATS_SQL}, m AS (
  SELECT cluster_id, {mood_case('d', 'e', 'v')} AS mood FROM (SELECT cluster_id,
    max(CASE WHEN j = 0 THEN mean END) AS d, max(CASE WHEN j = 1 THEN mean END) AS e,
    max(CASE WHEN j = 2 THEN mean END) AS v FROM s GROUP BY cluster_id))
SELECT t.*, mood FROM ({_STATS_SELECT}) t JOIN m ON t.cluster_id = m.cluster_id
WHERE t.cluster_id = 3""")
def cluster_info(spark, d):
    stats = clusters.cluster_stats(embeddings(spark, d), "embedding")
    one = clusters.cluster_info(stats, clusters.mood_labels(stats), 3)
    return _stats_long(one).join(one.select("cluster_id", "mood"), "cluster_id")


@query(f"""WITH {E_SQL}, {STATS_SQL} SELECT cluster_id, j::INTEGER AS position, 'f' || j AS feature,
  'F' || j AS feature_title, {s6('mean')} AS mean, CASE WHEN mean > 0.5 THEN 'High'
  WHEN mean < -0.5 THEN 'Low' ELSE 'Medium' END AS level FROM s WHERE j < 5""")
def cluster_feature_levels(spark, d):
    stats = clusters.cluster_stats(embeddings(spark, d), "embedding")
    return rounded(clusters.feature_levels(stats, E_FEATURES), "mean")


@query(f"""WITH {V_SQL}, {VM_SQL}, g AS (SELECT cluster, avg(value) AS value, avg(k) AS k,
  avg(hour) AS hour FROM v WHERE cluster <> -1 GROUP BY cluster),
u AS (SELECT cluster, 'value' AS feature, value AS mean FROM g UNION ALL
      SELECT cluster, 'k', k FROM g UNION ALL SELECT cluster, 'hour', hour FROM g)
SELECT cluster, coalesce(mood, 'Cluster ' || cluster) AS mood, feature, {s6('mean')} AS mean
FROM u LEFT JOIN vm ON cluster = cluster_id""")
def cluster_heatmap(spark, d):
    out = report.cluster_heatmap(events(spark, d), V_FEATURES, event_moods(spark, d))
    return rounded(out, "mean")


_BOX_SQL = f"""WITH {V_SQL}, {VM_SQL},
u AS (SELECT event_id, coalesce(mood, 'Cluster ' || cluster) AS mood, feature, x AS value FROM (
        SELECT event_id, cluster, 'value' AS feature, value AS x FROM v UNION ALL
        SELECT event_id, cluster, 'k', k FROM v UNION ALL
        SELECT event_id, cluster, 'hour', hour::DOUBLE FROM v) LEFT JOIN vm ON cluster = cluster_id
      WHERE x IS NOT NULL),
b AS (SELECT mood, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM u GROUP BY mood, feature),
f AS (SELECT u.*, q1, median, q3, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS out
      FROM u JOIN b ON u.mood = b.mood AND u.feature = b.feature)"""


@query(_BOX_SQL + f"""
SELECT mood, feature, {s6('q1')} AS q1, {s6('median')} AS median, {s6('q3')} AS q3, count(*) AS n,
  {s6('min(CASE WHEN NOT out THEN value END)')} AS whisker_low,
  {s6('max(CASE WHEN NOT out THEN value END)')} AS whisker_high,
  CAST(sum(out::INTEGER) AS BIGINT) AS n_outliers FROM f GROUP BY mood, feature, q1, median, q3""")
def boxplot_stats(spark, d):
    named = clusters.attach_moods(events(spark, d), event_moods(spark, d))
    out = report.boxplot_stats(named, V_FEATURES)
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(_BOX_SQL + f" SELECT event_id, mood, feature, {s6('value')} AS value FROM f WHERE out")
def boxplot_outliers(spark, d):
    named = clusters.attach_moods(events(spark, d), event_moods(spark, d))
    return rounded(report.boxplot_outliers(named, "event_id", V_FEATURES), "value")


@query(f"""SELECT p_partkey, 'p_size' AS feature, {s6('p_size / 50.0::DOUBLE')} AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', {s6('(p_retailprice + 60) / 1000.0::DOUBLE')} FROM part""")
def radar_profile(spark, d):
    domains = {"p_size": (0.0, 50.0), "p_retailprice": (-60.0, 940.0), "absent": (0.0, 1.0)}
    return rounded(report.radar_profile(table(spark, d, "part"), "p_partkey", domains), "value")


# --- quality of given labels ------------------------------------------------------------


_SIL_SQL = """k AS (SELECT cluster, count(*) AS n FROM e GROUP BY cluster),
q AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.v, b.v)) AS s
      FROM e a, e b GROUP BY a.vec_id, a.cluster, b.cluster),
w AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS size,
             max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a,
             min(CASE WHEN own <> other THEN s / n END) AS b
      FROM q JOIN k ON q.other = k.cluster GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN size > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END)
        AS x FROM w)"""
_MOM_SQL = """j AS (SELECT cluster, i, v[i] AS x FROM e, range(1, 65) AS r(i)),
g AS (SELECT cluster, i, count(*) AS n, avg(x) AS m, var_pop(x) AS vp FROM j GROUP BY cluster, i),
t AS (SELECT i, avg(x) AS mu FROM j GROUP BY i),
ch AS (SELECT sum(n * pow(m - mu, 2)) * ((SELECT count(*) FROM e) - count(DISTINCT cluster))
       / (sum(n * vp) * (count(DISTINCT cluster) - 1)) AS x FROM g JOIN t ON g.i = t.i)"""
_DB_SQL = """c AS (SELECT cluster, list(m ORDER BY i) AS v FROM g GROUP BY cluster),
sp AS (SELECT e.cluster, avg(list_distance(e.v, c.v)) AS s FROM e JOIN c ON e.cluster = c.cluster
       GROUP BY e.cluster),
db AS (SELECT avg(r) AS x FROM (SELECT a.cluster, max((sa.s + sb.s) / list_distance(a.v, b.v)) AS r
       FROM c a JOIN c b ON a.cluster <> b.cluster JOIN sp sa ON sa.cluster = a.cluster
       JOIN sp sb ON sb.cluster = b.cluster GROUP BY a.cluster))"""


@query(f"WITH {E_SQL}, {_SIL_SQL} SELECT {s6('x')} AS silhouette FROM sil")
def silhouette_exact(spark, d):
    return rounded(quality.silhouette(embeddings(spark, d), "embedding"), "silhouette")


@query(f"WITH {E_SQL}, {_MOM_SQL} SELECT {s6('x')} AS calinski_harabasz FROM ch")
def calinski_harabasz(spark, d):
    out = quality.calinski_harabasz(embeddings(spark, d), "embedding")
    return rounded(out, "calinski_harabasz")


@query(f"WITH {E_SQL}, {_MOM_SQL}, {_DB_SQL} SELECT {s6('x')} AS davies_bouldin FROM db")
def davies_bouldin(spark, d):
    return rounded(quality.davies_bouldin(embeddings(spark, d), "embedding"), "davies_bouldin")


@query(f"""WITH {E_SQL}, {_SIL_SQL}, {_MOM_SQL}, {_DB_SQL} SELECT {s6('sil.x')} AS silhouette,
  {s6('ch.x')} AS calinski_harabasz, {s6('db.x')} AS davies_bouldin FROM sil, ch, db""")
def clustering_quality(spark, d):
    out = quality.clustering_quality(embeddings(spark, d), "embedding")
    return rounded(out, *out.columns)


@query(f"""WITH {E_SQL}, {_CENTRE_SQL},
p AS (SELECT vec_id, cluster_id, list_distance(e.v, c.v) AS dist FROM e, c)
SELECT vec_id, cluster_id::INTEGER AS nearest, {s6('dist')} AS distance FROM p
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) = 1""")
def nearest_centroid(spark, d):
    # One centre per label.
    centres = label_centres(spark, d).orderBy("cluster_id").collect()
    out = kmeans.assign_nearest(
        embeddings(spark, d), "embedding", [r["embedding"] for r in centres], "nearest", "distance",
        [r["cluster_id"] for r in centres],
    )
    return rounded(out.select("vec_id", "nearest", "distance"), "distance")


# --- density ----------------------------------------------------------------------------


_Z_SQL = """ev AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
z AS (SELECT event_id, (value - (SELECT avg(value) FROM ev)) / (SELECT stddev_pop(value) FROM ev) AS x,
             (k - (SELECT avg(k) FROM ev)) / (SELECT stddev_pop(k) FROM ev) AS y FROM ev)"""


@query(f"""WITH {_Z_SQL}
SELECT a.event_id, count(*) >= {MIN_SAMPLES} AS is_core FROM z a JOIN z b
  ON b.x BETWEEN a.x - {EPS} AND a.x + {EPS} AND b.y BETWEEN a.y - {EPS} AND a.y + {EPS}
 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {EPS} * {EPS} GROUP BY a.event_id""")
def eps_neighbors(spark, d):
    return dbscan.core_points(scaled_events(spark, d), "event_id", ["value", "k"], EPS, MIN_SAMPLES)


def _near(a: str, b: str) -> str:
    return f"""{b}.x BETWEEN {a}.x - {EPS} AND {a}.x + {EPS} AND {b}.y BETWEEN {a}.y - {EPS}
      AND {a}.y + {EPS} AND pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2) <= {EPS} * {EPS}"""


@query(f"""WITH RECURSIVE {_Z_SQL},
core AS MATERIALIZED (SELECT event_id, x, y, floor(x / ({EPS} / sqrt(2.0))) AS cx,
    floor(y / ({EPS} / sqrt(2.0))) AS cy FROM (SELECT a.event_id, a.x, a.y, count(*) AS n
    FROM z a JOIN z b ON {_near('a', 'b')} GROUP BY ALL) WHERE n >= {MIN_SAMPLES}),
cell AS MATERIALIZED (SELECT cx, cy, min(event_id) AS cell FROM core GROUP BY cx, cy),
pt AS MATERIALIZED (SELECT event_id, x, y, cell FROM core JOIN cell USING (cx, cy)),
edge AS MATERIALIZED (SELECT DISTINCT a.cell AS s, b.cell AS t FROM pt a JOIN pt b
  ON {_near('a', 'b')} WHERE a.cell <> b.cell),
comp(node, root) USING KEY (node) AS (
  SELECT cell, cell FROM cell
  UNION
  SELECT e.t, min(c.root) FROM comp c JOIN edge e ON e.s = c.node
    JOIN recurring.comp r ON r.node = e.t WHERE c.root < r.root GROUP BY e.t),
num AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM comp),
lab AS (SELECT event_id, x, y, cluster FROM pt JOIN num ON cell = node)
SELECT z.event_id, coalesce(own.cluster,
  (SELECT min(b.cluster) FROM lab b WHERE {_near('z', 'b')}), -1)::INTEGER AS cluster
FROM z LEFT JOIN lab own ON own.event_id = z.event_id""")
def density_clusters(spark, d):
    out = dbscan.dbscan(scaled_events(spark, d), "event_id", ["value", "k"], EPS, MIN_SAMPLES)
    return out.select("event_id", "cluster")


def _dense_sql(points: str, d: int, eps: float, m: int) -> str:
    """DBSCAN over `points` (CTEs ending in p(id, v, c0, c1)), with all neighbour pairs written out."""
    squares = " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, d + 1))
    return f"""WITH RECURSIVE {points},
near AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM p a JOIN p b
  ON b.c0 BETWEEN a.c0 - {eps} AND a.c0 + {eps} AND b.c1 BETWEEN a.c1 - {eps} AND a.c1 + {eps}
 AND {squares} <= {eps} * {eps}),
core AS MATERIALIZED (SELECT s AS id FROM near GROUP BY s HAVING count(*) >= {m}),
edge AS MATERIALIZED (SELECT s, t FROM near WHERE s IN (FROM core) AND t IN (FROM core)),
comp(node, root) USING KEY (node) AS (
  SELECT id, id FROM core
  UNION
  SELECT e.t, min(c.root) FROM comp c JOIN edge e ON e.s = c.node
    JOIN recurring.comp r ON r.node = e.t WHERE c.root < r.root GROUP BY e.t),
lab AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM comp),
edge_of AS (SELECT near.s, min(lab.cluster) AS cluster FROM near JOIN lab ON lab.node = near.t GROUP BY near.s)
SELECT p.id, coalesce(lab.cluster, edge_of.cluster, -1)::INTEGER AS cluster
FROM p LEFT JOIN lab ON lab.node = p.id LEFT JOIN edge_of ON edge_of.s = p.id"""


ORDER_EPS, ORDER_SAMPLES = 0.08, 20
VECTOR_EPS, VECTOR_SAMPLES = 0.2, 4


@query(_dense_sql("""p AS (SELECT id, v, v[1] AS c0, v[2] AS c1 FROM (SELECT l_orderkey AS id,
  [max(l_quantity) / 50, max(l_extendedprice) / 100000, max(l_discount) * 10, max(l_tax) * 10] AS v
  FROM lineitem GROUP BY l_orderkey))""", 4, ORDER_EPS, ORDER_SAMPLES))
def density_clusters_orders(spark, d):
    """Orders by four features of their lines."""
    rows = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            (F.max("l_quantity") / 50).alias("quantity"),
            (F.max("l_extendedprice") / 100000).alias("price"),
            (F.max("l_discount") * 10).alias("discount"),
            (F.max("l_tax") * 10).alias("tax"),
        )
    )
    features = ["quantity", "price", "discount", "tax"]
    return dbscan.dbscan(rows, "id", features, ORDER_EPS, ORDER_SAMPLES).select("id", "cluster")


@query(_dense_sql("""p AS (SELECT vec_id AS id, v, v[1] AS c0, v[2] AS c1 FROM
  (SELECT vec_id, CAST(embedding[1:9] AS DOUBLE[]) AS v FROM embeddings))""", 9, VECTOR_EPS, VECTOR_SAMPLES))
def density_clusters_vectors(spark, d):
    """Vectors by their first nine dimensions."""
    rows = embeddings(spark, d).select(
        F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in range(9)]
    )
    out = dbscan.dbscan(rows, "id", [f"x{i}" for i in range(9)], VECTOR_EPS, VECTOR_SAMPLES)
    return out.select("id", "cluster")


# --- payload flattening --------------------------------------------------------------------


def _event_payloads(spark, d) -> DataFrame:
    """Track and feature payloads as JSON text, made from the events table."""
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    track = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("name"),
        F.array(
            F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("name")),
            F.struct(F.col("event_type").alias("name")),
        ).alias("artists"),
        F.struct(F.concat(F.lit("day "), F.dayofmonth("ts")).alias("name")).alias("album"),
        k.alias("popularity"),
        F.lit(1).alias("duration_ms"),
        (F.col("event_type") == "error").alias("explicit"),
    )
    features = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.round(F.col("value") / 100, 4).alias("energy"),
        (k / 128).alias("valence"),
        (k % 12).alias("key"),
        (F.col("user_id") * 1000).cast("int").alias("duration_ms"),
    )
    return ev.select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 11 != 3, F.to_json(track)).alias("track_json"),
        F.when(F.col("event_id") % 7 != 2, F.to_json(features)).alias("features_json"),
    )


@query("""SELECT event_id::VARCHAR AS track_id, event_type AS track_name,
  'user ' || user_id || ', ' || event_type AS artists, 'day ' || day(ts) AS album_name,
  json_extract_string(props, '$.k')::INTEGER AS popularity, (user_id * 1000)::INTEGER AS duration_ms,
  event_type = 'error' AS explicit, round(value / 100, 4) AS energy,
  json_extract_string(props, '$.k')::INTEGER / 128.0::DOUBLE AS valence,
  json_extract_string(props, '$.k')::INTEGER % 12 AS key
FROM events WHERE event_id % 11 <> 3 AND event_id % 7 <> 2""")
def json_enrich(spark, d):
    raw = _event_payloads(spark, d)
    tracks = nested.parse(raw, "track_json", nested.TRACK_TYPE, "track").select("track")
    features = nested.parse(raw, "features_json", nested.FEATURES_TYPE, "features").select("features")
    return nested.enrich(tracks, features).select(
        "track_id", "track_name", "artists", "album_name", "popularity", "duration_ms", "explicit",
        "energy", "valence", "key",
    )


def _turns(spark, d) -> DataFrame:
    """Conversation turns as track payloads."""
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.struct(
            F.concat_ws("-", "conv_id", "turn").alias("id"),
            F.col("text").alias("name"),
            F.array(F.struct(F.col("role").alias("name"))).alias("artists"),
            F.struct(F.concat(F.lit("conversation "), F.col("conv_id")).alias("name")).alias("album"),
            F.length("text").alias("popularity"),
            F.col("turn").cast("int").alias("duration_ms"),
            (F.col("role") == "user").alias("explicit"),
        ).alias("track"),
    )


_TURN_SQL = """SELECT conv_id || '-' || turn AS track_id, text AS track_name, role AS artists,
  'conversation ' || conv_id AS album_name, length(text)::INTEGER AS popularity,
  turn::INTEGER AS duration_ms, role = 'user' AS explicit FROM conversations"""


@query(_TURN_SQL)
def json_search_flatten(spark, d):
    # One page per turn: a page never gathers an unbounded conversation.
    page = F.to_json(
        F.struct(F.struct(F.array("track").alias("items")).alias("tracks"))
    ).alias("page_json")
    pages = _turns(spark, d).select(page)
    return nested.flatten_search(nested.parse(pages, "page_json", nested.SEARCH_TYPE, "page"))


@query(_TURN_SQL + " WHERE turn % 3 <> 1")
def json_playlist_flatten(spark, d):
    item = F.struct(F.when(F.col("turn") % 3 != 1, F.col("track")).alias("track"))
    page = F.to_json(
        F.struct(F.array(item).alias("items"), F.lit("next").alias("next")),
        {"ignoreNullFields": "false"},
    ).alias("page_json")
    pages = _turns(spark, d).select(page)
    return nested.flatten_playlist(nested.parse(pages, "page_json", nested.PLAYLIST_TYPE, "page"))


# --- fitted models: no SQL equivalent, checked by invariants in tests -----------------------------


@query()
def kmeans_fit(spark, d):
    df = embeddings(spark, d)
    fit = kmeans.fit_kmeans(df, "embedding", 10)
    out = kmeans.assign_nearest(df, "embedding", fit.centers, "cluster", "distance")
    return rounded(out.select("vec_id", "cluster", "distance"), "distance")


@query()
def auto_k(spark, d):
    df = embeddings(spark, d)
    table_ = kmeans.find_optimal_k(df, "embedding")[1]
    return rounded(table_, "silhouette", "calinski_harabasz", "davies_bouldin", "cost")


@query()
def cluster_fit(spark, d):
    fitted, prepared = _processor().fit_transform(events(spark, d))
    model, labelled = clustering.fit_clusters(
        prepared, fitted.feature_columns, k=5, label_on=["value", "k", "hour_sin"]
    )
    moods = spark.createDataFrame(list(model.mood_labels.items()), "cluster_id int, mood string")
    return clusters.attach_moods(labelled.select("event_id", "cluster"), moods)


@query()
def hierarchical_cluster(spark, d):
    out = hierarchy.hierarchical(embeddings(spark, d), "embedding", 6)
    return out.select("vec_id", "cluster")


@query()
def pca_scatter(spark, d):
    df = embeddings(spark, d)
    moods = clusters.mood_labels(clusters.cluster_stats(df, "embedding"))
    return rounded(pca.pca_scatter(df, "vec_id", "embedding", moods=moods), "x", "y")


@query(f"""WITH {E_SQL}, p AS (SELECT a.vec_id AS query_id, list_distance(a.v, b.v) AS distance
  FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query_id, {s6('1 / (1 + min(distance))')} AS similarity_score FROM p GROUP BY query_id""")
def best_similarity(spark, d):
    near = knn(embeddings(spark, d), id_col="vec_id", features="embedding", k=2)
    near = near.where("query_id <> vec_id").where(F.col("rank") <= 2)
    best = near.groupBy("query_id").agg(F.min("distance").alias("distance"))
    return best.select("query_id", r6(similarity(F.col("distance"))).alias("similarity_score"))


__all__ = ["ORACLES", "QUERIES"]
