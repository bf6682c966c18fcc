"""Collecting key-value rows into one map per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.operators.joins import SPREAD, group_for_join


def collect_map(
    df: DataFrame,
    group_columns: Sequence[str],
    key: str,
    value: str,
    order_by: str | None = None,
    name: str = "tags",
) -> DataFrame:
    """One row per group with a map of its keys.

    Rows are first reduced to one value per group and key: the one with the
    largest ``order_by``, or the largest value. That step combines on the map
    side, so a hot group reaches the second step with its distinct keys only.
    The result may be joined to a table with hot groups, see
    :func:`viewforge.operators.joins.group_for_join`.
    """
    winner = F.max_by(F.col(value), F.struct(order_by, value)) if order_by else F.max(value)
    single = df.where(F.col(key).isNotNull()).groupBy(*group_columns, key).agg(winner.alias("_value"))
    entries = F.collect_list(F.struct(F.col(key).alias("key"), F.col("_value").alias("value")))
    folded = group_for_join(single, group_columns).agg(F.map_from_entries(F.array_sort(entries)).alias(name))
    return folded.drop(SPREAD)
