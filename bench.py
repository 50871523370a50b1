"""Time the headline queries and print one JSON line.

Each query runs twice and the second run is timed, so the numbers do not measure JVM warm-up.
Results are written in full to the no-op sink.

BENCH_SF_DIR   folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names to run instead of the headline list ("all" for all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinfold.operators import clean  # noqa: E402
from kinfold.plans.queries import L_FEATURES, QUERIES, table  # noqa: E402
from kinfold.session import local_session  # noqa: E402


def prepare_lineitem(spark, d):
    """The whole preparation over the largest table."""
    processor = clean.FeatureProcessor(features=L_FEATURES, periods={})
    return processor.fit_transform(table(spark, d, "lineitem").select("l_orderkey", *L_FEATURES))[1]


HEADLINE = [
    "prepare_lineitem",
    "prepare_features",
    "outlier_iqr",
    "describe_features",
    "correlation_matrix",
    "histogram_50",
    "boxplot_stats",
    "mood_lookup",
    "text_search",
    "json_enrich",
    "cluster_stats",
    "knn_euclidean",
    "knn_cosine",
    "knn_manhattan",
    "similar_postfilter",
    "similar_prefilter",
    "recommendation_summary",
    "nearest_centroid",
    "silhouette_exact",
    "calinski_harabasz",
    "davies_bouldin",
    "kmeans_fit",
    "hierarchical_cluster",
    "pca_scatter",
    "eps_neighbors",
    "density_clusters",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    runnable = {**QUERIES, "prepare_lineitem": prepare_lineitem}
    chosen = HEADLINE if not names else list(runnable) if names == "all" else names.split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="kinfold-bench")
    times = {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            runnable[name](spark, d).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of second runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
