"""Generated rows, completing given rows, and comparing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How row numbers and dates are written.
ROW_PATTERN = "%04d"
DATE_TEXT_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def sequential_value(name: str, data_type: T.DataType, number: Column, pattern: str = ROW_PATTERN) -> Column:
    """The value of one column in row ``number``; dates are ISO text, ``number`` seconds after 1970."""
    if isinstance(data_type, T.BooleanType):
        return number % 2 == 0
    if isinstance(data_type, T.StringType):
        return F.concat(F.lit(f"{name}-"), F.format_string(pattern, number))
    if isinstance(data_type, T.NumericType):
        return number.cast(data_type)
    if isinstance(data_type, (T.DateType, T.TimestampType)):
        return F.date_format(F.timestamp_seconds(number), DATE_TEXT_PATTERN)
    if isinstance(data_type, T.StructType):
        return F.struct(*(sequential_value(f.name, f.dataType, number, pattern).alias(f.name) for f in data_type))
    if isinstance(data_type, T.ArrayType):
        return F.array().cast(data_type)
    if isinstance(data_type, T.MapType):
        return F.create_map().cast(data_type)
    raise ValueError(f"no generated value for {name}: {data_type.simpleString()}")


def sequential_columns(schema: T.StructType, number: Column, pattern: str = ROW_PATTERN) -> list[Column]:
    return [sequential_value(f.name, f.dataType, number, pattern).alias(f.name) for f in schema]


def sequential_rows(spark: SparkSession, schema: T.StructType, n: int, pattern: str = ROW_PATTERN) -> DataFrame:
    """``n`` generated rows, numbered from 0."""
    return spark.range(n).select(*sequential_columns(schema, F.col("id"), pattern))


def fill_missing(
    df: DataFrame,
    schema: T.StructType,
    given: str,
    number: Column,
    null_fields: bool = False,
    pattern: str = ROW_PATTERN,
) -> DataFrame:
    """Rows of ``schema`` where columns that a row does not give are generated.

    ``given`` is an array column with the names each row gives; a given null
    stays null. With ``null_fields`` the others become null.
    """
    columns = []
    for f in schema:
        generated = (
            F.lit(None).cast(f.dataType) if null_fields else sequential_value(f.name, f.dataType, number, pattern)
        )
        if f.name in df.columns:
            columns.append(
                F.when(F.array_contains(given, f.name), F.col(f.name)).otherwise(generated).alias(f.name)
            )
        else:
            columns.append(generated.alias(f.name))
    return df.select(*columns)


def table_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows whose number differs, with ``n_expected`` and ``n_actual``.

    Empty exactly when both tables sorted alike are equal row by row. Rows are
    counted, so copies of one row travel as one partial count.
    """
    columns = expected.columns

    def sided(df: DataFrame, side: int) -> DataFrame:
        return df.select(*columns, F.lit(1 - side).alias("_expected"), F.lit(side).alias("_actual"))

    return (
        sided(expected, 0)
        .union(sided(actual, 1))
        .groupBy(*columns)
        .agg(F.sum("_expected").alias("n_expected"), F.sum("_actual").alias("n_actual"))
        .where(F.col("n_expected") != F.col("n_actual"))
    )


def table_diff_by_key(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences paired by key: ``status`` is missing, unexpected or changed."""
    others = [c for c in expected.columns if c not in keys]
    left = expected.select(*keys, F.struct(*others).alias("expected_row"))
    right = actual.select(*keys, F.struct(*others).alias("actual_row"))
    status = (
        F.when(F.col("actual_row").isNull(), "missing")
        .when(F.col("expected_row").isNull(), "unexpected")
        .otherwise("changed")
    )
    joined = left.join(right, list(keys), "full")
    return joined.where(~F.col("expected_row").eqNullSafe(F.col("actual_row"))).select(
        *keys, status.alias("status"), "expected_row", "actual_row"
    )
