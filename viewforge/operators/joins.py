"""Joins that need more than one plain join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


SPREAD = "_spread"


def spread_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*columns).alias(SPREAD)


def group_for_join(df: DataFrame, columns: Sequence[str]) -> GroupedData:
    """``df.groupBy(columns)`` for a result that is then joined on the same columns.

    Adaptive execution splits a hot key only where both sides of a join come
    straight from a shuffle. An aggregate on the join columns would lend the join
    its own partitioning instead and leave the other side's hot key in one task.
    Grouping by a hash of the columns as well gives the same groups but another
    partitioning, so the join shuffles the small aggregate once more and may be
    split. Drop :data:`SPREAD` from the result.
    """
    return df.groupBy(*columns, spread_hash(columns))


def optional_join(df: DataFrame, other: DataFrame, column: str, other_column: str) -> DataFrame:
    """``df LEFT JOIN other ON column = other_column`` for an ``other`` with hot keys.

    Adaptive execution splits only the kept side of an outer join, so a hot key of
    the other side would stay in one task. Both sides of an inner join are split;
    rows without a partner come from an anti join with the distinct keys, which
    are found on the map side. The frames share no column name.
    """
    on = F.col(column) == F.col(other_column)
    matched = df.join(other, on)
    keys = group_for_join(other, [other_column]).agg(F.lit(True).alias("_present")).select(other_column)
    return matched.unionByName(df.join(keys, on, "left_anti"), allowMissingColumns=True)


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows with ``column NOT IN (values)``, nulls treated as SQL does.

    Spark runs a nullable NOT IN by broadcasting all values, whatever their
    number. Here an ordinary anti join, which shuffles both sides when they are
    large, finds the rows without a partner, and two counts settle the null cases:
    any null among the values leaves no row, and a null in ``column`` passes only
    when there are no values at all.
    """
    name = values.columns[0]
    value = values.select(F.col(name).alias("_value"))
    known = group_for_join(value, ["_value"]).agg(F.lit(True).alias("_present")).select("_value")
    counts = value.agg(F.count(F.lit(1)).alias("n"), F.count("_value").alias("n_known"))
    n, n_known = counts.select("n").scalar(), counts.select("n_known").scalar()
    unmatched = df.join(known, F.col(column) == F.col("_value"), "left_anti")
    return unmatched.where((n == n_known) & (F.col(column).isNotNull() | (n == 0)))
