"""Search and facets over a catalogue table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The age ranges in hours; None means any age.
HOUR_RANGES = {
    "last_hour": 1,
    "last_day": 24,
    "last_week": 168,
    "last_month": 672,
    "last_year": 8760,
    "older": None,
}


@dataclass(frozen=True)
class Facet:
    """``combine`` is AND, OR or EXCLUSIVE; an excluding facet ignores its own selection when counted."""

    column: str
    combine: str = "OR"
    exclude_own: bool = False


def search_condition(columns: Sequence[str], query: str) -> Column:
    """All blank-separated terms occur, in any of the columns; an empty query matches all."""
    text = F.lower(F.concat_ws(" ", *columns))
    condition = F.lit(True)
    for term in query.lower().split():
        condition = condition & text.contains(term)
    return condition


def facet_search_terms(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    return df.where(search_condition(columns, query))


def facet_condition(df: DataFrame, facet: Facet, values: Sequence[str]) -> Column:
    column = F.col(facet.column)
    if isinstance(df.schema[facet.column].dataType, T.ArrayType):
        tests = [F.array_contains(column, v) for v in values]
    else:
        tests = [column == F.lit(v) for v in values]
    condition = tests[0]
    for test in tests[1:]:
        condition = condition & test if facet.combine == "AND" else condition | test
    return condition


def facet_filter(df: DataFrame, facets: Sequence[Facet], selected: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = df
    for facet in facets:
        if selected.get(facet.column):
            rows = rows.where(facet_condition(df, facet, selected[facet.column]))
    return rows


def facet_counts(df: DataFrame, facets: Sequence[Facet], selected: Mapping[str, Sequence[str]]) -> DataFrame:
    """``facet, value, n`` for all facets from one scan.

    Each row states per facet whether it passes the selections that count there,
    so every facet is counted in the same aggregation.
    """
    conditions = {
        f.column: F.coalesce(facet_condition(df, f, selected[f.column]), F.lit(False))
        for f in facets
        if selected.get(f.column)
    }
    entries = []
    for facet in facets:
        passes = F.lit(True)
        for column, condition in conditions.items():
            if not (facet.exclude_own and column == facet.column):
                passes = passes & condition
        column = F.col(facet.column)
        many = isinstance(df.schema[facet.column].dataType, T.ArrayType)
        values = F.array_distinct(column).cast("array<string>") if many else F.array(column.cast("string"))
        entries.append(
            F.struct(
                F.lit(facet.column).alias("facet"),
                F.when(passes, values).otherwise(F.array().cast("array<string>")).alias("vals"),
            )
        )
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.facet", F.explode("e.vals").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def facet_hour_ranges(df: DataFrame, moment: Column, now: Column) -> DataFrame:
    """One row with the count of each age range. Ranges overlap; "older" is everything up to now."""
    aggregates = []
    for name, hours in HOUR_RANGES.items():
        inside = moment <= now
        if hours is not None:
            inside = inside & (moment >= now - F.expr(f"interval {hours} hour"))
        aggregates.append(F.count_if(inside).alias(name))
    return df.agg(*aggregates)


def facet_page(df: DataFrame, key: str, page: int, size: int) -> DataFrame:
    """One page of hits in key order, with the number of hits and of pages."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return (
        df.orderBy(key)
        .offset(page * size)
        .limit(size)
        .withColumn("total", total)
        .withColumn("pages", F.ceil(F.col("total") / F.lit(size)).cast("long"))
    )


def highlight(text: Column, query: str) -> Column:
    """Wrap every occurrence of a term in ``<b>``; longer terms win over their parts."""
    terms = sorted(set(query.split()), key=lambda t: (-len(t), t))
    if not terms:
        return text
    pattern = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(text, f"(?i)({pattern})", "<b>$1</b>")


def categories_grouped(assignments: DataFrame) -> DataFrame:
    """Per table and taxonomy: the categories and the category objects in use, sorted."""
    return assignments.groupBy("table_name", "taxonomy").agg(
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("category_object")).alias("category_objects"),
    )
