"""Fitted steps on a stream.

Preparing, labelling and naming rows are projections over stored parameters, so the batch
functions run unchanged on a streaming DataFrame, with no state and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import FeatureProcessor
from ..operators.clustering import ClusterModel


def score(
    rows: DataFrame, processor: FeatureProcessor, model: ClusterModel, cluster: str = "cluster"
) -> DataFrame:
    """Prepared features, cluster and mood for each arriving row."""
    labelled = model.predict(processor.transform(rows), cluster)
    # The names are a fixed map of a few clusters, so no join is needed.
    pairs = [F.lit(x) for item in model.mood_labels.items() for x in item]
    mood = F.try_element_at(F.create_map(*pairs), F.col(cluster)) if pairs else F.lit(None)
    return labelled.withColumn("mood", F.coalesce(mood, F.lit("Unknown")))
