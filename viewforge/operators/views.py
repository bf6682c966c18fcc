"""Filling and reading views: partitions, overwrites, suffix tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.functions.dates import date_id, day_text, month_id, month_text, year_text
from viewforge.functions.paths import path_value, value_of_path
from viewforge.model import ViewDef, escape_path_value
from viewforge.sources.formats import conform, read_view, write_view

__all__ = [
    "add_partitions",
    "conform",
    "insert_dynamically_into",
    "insert_into",
    "path_value",
    "partition_filter",
    "read_suffix_table",
    "select_all",
    "select_all_ordered",
    "value_of_path",
    "with_date_id",
    "with_job_metadata",
    "with_month_id",
    "write_suffix_tables",
]

# Fixed value: how job times are written.
JOB_TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def with_job_metadata(df: DataFrame, created_at: str, created_by: str) -> DataFrame:
    """Add who made the rows and when; both are given, so a rerun gives the same rows."""
    return df.withColumns({"created_at": F.lit(created_at), "created_by": F.lit(created_by)})


def _with_params(df: DataFrame, view: ViewDef, params: Mapping[str, object]) -> DataFrame:
    return df.withColumns({f.column: F.lit(params[f.column]).cast(f.data_type) for f in view.partitions})


def insert_into(
    df: DataFrame,
    view: ViewDef,
    path: str,
    params: Mapping[str, object] | None = None,
) -> None:
    """Overwrite one partition, or the whole table when no parameters are given.

    The partition folder is the write target, so other partitions are not
    touched and an empty result empties the partition.
    """
    if not params:
        write_view(df, view, path, mode="overwrite")
        return
    missing = [c for c in view.partition_columns if c not in params]
    if missing:
        raise ValueError(f"no value for partition columns {missing}")
    unpartitioned = replace(view, partitions=())
    write_view(df, unpartitioned, path + view.partition_path(params), mode="overwrite")


def insert_dynamically_into(df: DataFrame, view: ViewDef, path: str) -> None:
    """Overwrite exactly the partitions that occur in ``df``."""
    write_view(df, view, path, mode="overwrite", dynamic=True)


def partition_filter(view: ViewDef, params: Mapping[str, object]) -> Column:
    """Equality on partition columns, typed as declared; unknown names are refused."""
    by_name = {f.column: f for f in view.partitions}
    unknown = [name for name in params if name not in by_name]
    if unknown:
        raise ValueError(f"unknown partition columns {unknown}")
    condition = F.lit(True)
    for name, value in params.items():
        condition = condition & (F.col(name) == F.lit(value).cast(by_name[name].data_type))
    return condition


def select_all(spark: SparkSession, view: ViewDef, path: str, params: Mapping[str, object]) -> DataFrame:
    """Rows of the partitions that match; other folders are pruned."""
    return read_view(spark, view, path).where(partition_filter(view, params))


def select_all_ordered(
    spark: SparkSession, view: ViewDef, path: str, params: Mapping[str, object], order_by: str
) -> DataFrame:
    """Like :func:`select_all`, sorted by the text of one column with null as empty text.

    The other columns break ties, so that many equal values do not end up in one
    sort task and the order is always the same.
    """
    rows = select_all(spark, view, path, params)
    ties = [f.column for f in view.ordered_fields if f.column != order_by and _orderable(f.data_type)]
    return rows.orderBy(F.coalesce(F.col(order_by).cast("string"), F.lit("")), *ties)


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type)
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    return not isinstance(data_type, T.MapType)


def write_suffix_tables(df: DataFrame, view: ViewDef, root: str) -> DataFrame:
    """One table per suffix value, written in a single pass.

    Rows are laid out by suffix columns, each folder is one table, and the
    suffix leaves the row because it lives in the folder name. Returns one row
    per table: ``table_name, path`` and the suffix values.
    """
    spark = df.sparkSession
    base = view.path(root)
    layout = replace(view, suffixes=(), partitions=(*view.suffixes, *view.partitions))
    write_view(df, layout, base, mode="overwrite")
    names = [f.column for f in view.suffixes]
    text = [F.col(c).cast("string") for c in names]
    folders = [F.concat(F.lit(f"/{c}="), path_value(F.col(c))) for c in names]
    values = read_view(spark, layout, base).select(*names).distinct()
    return values.select(
        F.concat_ws("_", F.lit(view.table_name()), *(F.lower(t) for t in text)).alias("table_name"),
        F.concat(F.lit(base), *folders).alias("path"),
        *names,
    )


def read_suffix_table(
    spark: SparkSession, view: ViewDef, root: str, suffix_values: Sequence[object]
) -> DataFrame:
    folder = "".join(f"/{f.column}={escape_path_value(v)}" for f, v in zip(view.suffixes, suffix_values))
    return read_view(spark, replace(view, suffixes=()), view.path(root) + folder)


def add_partitions(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """State with the wanted ``view, partition`` rows added; known ones stay as they are."""
    new = (
        wanted.select("view", "partition")
        .distinct()
        .join(state, ["view", "partition"], "left_anti")
        .select("view", "partition", F.lit("0").alias("checksum"), F.lit(0).cast("long").alias("ts"))
    )
    return state.select("view", "partition", "checksum", "ts").unionByName(new)


def with_month_id(df: DataFrame, moment: str) -> DataFrame:
    at = F.col(moment)
    return df.withColumns({"year": year_text(at), "month": month_text(at), "month_id": month_id(at)})


def with_date_id(df: DataFrame, moment: str) -> DataFrame:
    at = F.col(moment)
    return df.withColumns(
        {"year": year_text(at), "month": month_text(at), "day": day_text(at), "date_id": date_id(at)}
    )
