"""Text search, row lookup and head."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_search(
    df: DataFrame,
    query: str,
    columns: Sequence[str],
    row_id: str,
    n: int = 20,
    n_empty: int = 10,
    literal: bool = False,
) -> DataFrame:
    """First `n` rows, in row order, where any column matches.

    The query is a case-insensitive regular expression (or plain text with
    `literal`); an empty query returns the first `n_empty` rows.
    """
    if not query:
        return head(df, row_id, n_empty)
    if literal:
        hits = [F.contains(F.lower(c), F.lit(query.lower())) for c in columns]
    else:
        hits = [F.col(c).rlike("(?iu)" + query) for c in columns]
    match = reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits])
    return head(df.where(match), row_id, n)


def head(df: DataFrame, row_id: str, n: int) -> DataFrame:
    return df.orderBy(row_id).limit(n)


def lookup(df: DataFrame, key: str, value, row_id: str | None = None) -> DataFrame:
    """The first row with the key, or no row; the filter is pushed to the scan."""
    return df.where(F.col(key) == F.lit(value)).orderBy(row_id or key).limit(1)


def entity_cluster(df: DataFrame, key: str, value, cluster: str = "cluster") -> int | None:
    row = lookup(df, key, value).select(cluster).first()
    return None if row is None or row[0] is None else int(row[0])
