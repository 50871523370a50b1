from .scalar import (  # noqa: F401
    circular_pair,
    display_label,
    domain_scale,
    feature_level,
    mood_name,
    nan_to_null,
    percent_text,
    similarity,
    title_case,
    whole_seconds,
)
from .vectors import as_vector, distance_expr, euclidean_to_literal  # noqa: F401
