"""Profiling tables and partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.operators.partitions import select_partitions
from viewforge.sources.files import list_files


def profile_aggregates(schema: T.StructType) -> list[Column]:
    """The metrics of every column that has any, named ``<column>__<metric>``."""
    metrics: list[Column] = [F.count(F.lit(1)).alias("agg_rows")]
    for f in schema:
        name, c = f.name, F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            metrics += [
                F.min(c).alias(f"{name}__min"),
                F.max(c).alias(f"{name}__max"),
                F.avg(c).alias(f"{name}__avg"),
                F.stddev_pop(c).alias(f"{name}__stddev"),
                F.sum(c).alias(f"{name}__sum"),
            ]
        elif isinstance(f.dataType, T.BooleanType):
            metrics += [
                F.count_if(c).alias(f"{name}__true"),
                F.count_if(~c | c.isNull()).alias(f"{name}__false"),
            ]
        elif isinstance(f.dataType, T.StringType):
            metrics += [F.min(c).alias(f"{name}__min"), F.max(c).alias(f"{name}__max")]
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            metrics += [F.min(F.size(c)).alias(f"{name}__min"), F.max(F.size(c)).alias(f"{name}__max")]
    return metrics


def profile_table(df: DataFrame) -> DataFrame:
    """One row with all metrics, from one pass with partial aggregation."""
    return df.agg(*profile_aggregates(df.schema))


def profile_long(df: DataFrame, table: str) -> DataFrame:
    """The metrics as rows ``id, fqdn, metric, value`` with the value as text."""
    profile = profile_table(df)
    pairs = F.array(
        *(
            F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in profile.columns
        )
    )
    return profile.select(F.explode(pairs).alias("m")).select(
        F.concat(F.lit(f"{table}."), "m.metric").alias("id"), F.lit(table).alias("fqdn"), "m.metric", "m.value"
    )


def sample_partition(
    df: DataFrame, params: Mapping[str, object], order_by: Sequence[str], n: int = 10
) -> DataFrame:
    """The first ``n`` rows of one partition; unknown parameter names are refused."""
    unknown = [p for p in params if p not in df.columns]
    if unknown:
        raise ValueError(f"unknown parameters {unknown}")
    rows = df
    for name, value in params.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(*order_by).limit(n)


def partition_stats(df: DataFrame, partition_columns: Sequence[str], changed: str | None = None) -> DataFrame:
    """Rows and last change per partition."""
    last = F.max(changed) if changed else F.lit(None).cast("timestamp")
    return df.groupBy(*partition_columns).agg(F.count(F.lit(1)).alias("n_rows"), last.alias("last_change"))


def partition_sizes(spark: SparkSession, path: str, partition_columns: Sequence[str]) -> DataFrame:
    """Bytes, files and last change per partition folder; only file listings are read."""
    files = list_files(spark, path)
    values = [F.regexp_extract("relative", rf"(?:^|/){c}=([^/]*)/", 1).alias(c) for c in partition_columns]
    return (
        files.select(*values, "length", "modified")
        .groupBy(*partition_columns)
        .agg(
            F.sum("length").alias("n_bytes"),
            F.count(F.lit(1)).alias("n_files"),
            F.max("modified").alias("last_change"),
        )
    )


def table_last_transformation(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Newest partition time per table; a table without one keeps its own time."""
    newest = partitions.groupBy("table_name").agg(F.max("ts").alias("newest"))
    return tables.join(newest, "table_name", "left").select(
        "table_name", F.coalesce("newest", "ts").alias("last_transformation")
    )


def parameter_values(partitions: DataFrame, text: str = "partition") -> DataFrame:
    """Distinct values per partition column from texts like ``year=2014/month=10``.

    Values come in the order in which they first occur among the sorted texts.
    Distinct pairs are found before anything is collected, so a list is as long
    as the number of values of its column.
    """
    pairs = partitions.select(F.col(text).alias("text"), F.explode(F.split(text, "/")).alias("pair")).where(
        F.col("pair").contains("=")
    )
    first = (
        pairs.select(
            "text",
            F.substring_index("pair", "=", 1).alias("parameter"),
            F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"),
        )
        .groupBy("parameter", "value")
        .agg(F.min("text").alias("first_text"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_text", "value")))
    return first.groupBy("parameter").agg(ordered.alias("ordered")).select(
        "parameter", F.col("ordered.value").alias("vals")
    )


def distinct_parameters(parameters: DataFrame) -> DataFrame:
    """Parameter names by their largest position."""
    return parameters.groupBy("name").agg(F.max("position").alias("max_position")).orderBy("max_position", "name")


def distinct_owners(tables: DataFrame) -> DataFrame:
    return tables.where(F.col("owner").isNotNull()).select("owner").distinct()


def top_tables(tables: DataFrame, n: int = 5) -> DataFrame:
    return tables.orderBy(F.col("view_count").desc(), "table_name").limit(n)


def latest_activities(activities: DataFrame, n: int = 10) -> DataFrame:
    return activities.orderBy(F.col("ts").desc(), F.col("activity_id").desc()).limit(n)


def partition_page(partitions: DataFrame, page: int, size: int, key: str = "partition") -> DataFrame:
    """Page ``page`` (from 0) in key order."""
    return partitions.orderBy(key).offset(page * size).limit(size)


RANGE = "_range"


class PageDirectory:
    """Rows laid out in ranges of their key, with the number of rows before each range.

    A page reads the ranges that hold it and no others, whatever its number. Rows of equal keys are ordered by
    their JSON text, nulls come first, and a page behind the last one is empty.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType) -> None:
        self.rows, self.key = spark.read.schema(T.StructType([*schema, T.StructField(RANGE, T.IntegerType())])).parquet(path), key
        counts = self.rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()
        ends = list(accumulate(c["n"] for c in counts))
        #: Number, rows before and rows up to its end of each range.
        self.ranges = [(c[RANGE], end - c["n"], end) for c, end in zip(counts, ends, strict=True)]

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str = "partition", ranges: int | None = None) -> PageDirectory:
        """Lay out ``rows`` under ``path`` in ``ranges`` ranges, as many as shuffle partitions unless told otherwise."""
        spark = rows.sparkSession
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.repartitionByRange(n, key).withColumn(RANGE, F.spark_partition_id())
        placed.write.partitionBy(RANGE).parquet(path)
        return cls(spark, path, key, rows.schema)

    def page(self, page: int, size: int) -> DataFrame:
        """Page ``page`` (from 0) in key order."""
        first = page * size
        held = [(number, before) for number, before, end in self.ranges if before < first + size and end > first]
        rows = self.rows.where(F.col(RANGE).isin([number for number, _ in held])).drop(RANGE)
        ordered = rows.orderBy(F.col(self.key), F.to_json(F.struct(*rows.columns)))
        return ordered.offset(first - held[0][1] if held else 0).limit(size)


def partition_position(partitions: DataFrame, value: object, key: str = "partition") -> DataFrame:
    """How many keys are smaller."""
    return partitions.where(F.col(key) < F.lit(value)).agg(F.count(F.lit(1)).alias("position"))


def status_overview(partitions: DataFrame) -> DataFrame:
    """Partitions per status."""
    return partitions.groupBy("status").agg(F.count(F.lit(1)).alias("n_partitions"))


def status_details(partitions: DataFrame) -> DataFrame:
    """Partitions per view and status, with the newest time."""
    return partitions.groupBy("view", "status").agg(
        F.count(F.lit(1)).alias("n_partitions"), F.max("ts").alias("newest")
    )


# Fixed value: the states in which a partition can carry issues.
FINISHED = ("materialized", "failed")


def status_filter(
    partitions: DataFrame,
    wanted: DataFrame | None = None,
    status: str | None = None,
    name_regex: str | None = None,
    issue: str | None = None,
) -> DataFrame:
    """Partitions by pattern set, status, whole-name regex and issue.

    ``issue`` is ``incomplete``, ``errors`` or both joined with ``AND``; it lets
    only finished partitions through. Spark's regular expressions search, so the
    pattern is anchored at both ends.
    """
    rows = partitions
    if wanted is not None:
        rows = select_partitions(rows, wanted)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if name_regex is not None:
        rows = rows.where(F.col("view").rlike(f"^(?:{name_regex})$"))
    if issue is not None:
        rows = rows.where(F.col("status").isin(*FINISHED))
        for flag in issue.split("AND"):
            rows = rows.where(F.col({"incomplete": "incomplete", "errors": "with_errors"}[flag.strip().lower()]))
    return rows
