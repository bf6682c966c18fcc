"""Recomputing the stale partitions of a view in one job."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.model import ViewDef
from viewforge.operators.state import append_state
from viewforge.operators.views import insert_dynamically_into, path_value, value_of_path
from viewforge.session import checkpointed, file_system, hadoop_path, remove_folder, scratch_path, stored
from viewforge.sources.files import list_files


def partition_text(names: Sequence[str]) -> Column:
    """``year=2014/month=10`` from partition columns: what state tables and folders call a partition."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{n}="), path_value(F.col(n))) for n in names))


def partition_values(partitions: DataFrame, view: ViewDef, text: str = "partition") -> DataFrame:
    """The typed partition columns of a view from partition texts, beside the text. Empty texts are null, as in folders."""
    values = [
        value_of_path(F.regexp_extract(text, rf"(?:^|/){re.escape(f.column)}=([^/]*)", 1)).cast(f.data_type).alias(f.column)
        for f in view.partitions
    ]
    return partitions.select(text, *values)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``folder, file`` of every file of a table; the folder is relative and without the file name."""
    if not file_system(spark, path).exists(hadoop_path(spark, path)):
        return spark.createDataFrame([], "folder string, file string")
    return list_files(spark, path).select(
        F.regexp_extract("relative", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("relative", "([^/]*)$", 1).alias("file")
    )


def refresh_partitions(
    view: ViewDef,
    build: Callable[[DataFrame], DataFrame],
    stale: DataFrame,
    path: str,
    state_path: str,
    checksum: str,
    now: int,
) -> DataFrame:
    """Rebuild the stale partitions of ``view`` and log their new state.

    ``build`` gets the wanted partition values and returns the rows of exactly
    those partitions; it may join or filter with them like with any table. All
    partitions are written by one job, each replaced as a whole. A wanted
    partition for which no row came is emptied. The state is logged last, so a
    run that breaks off is repeated by the next one. Returns ``view, partition,
    has_data``.

    State texts are only read, never compared: ``month=05`` and ``month=5`` both name
    the value 5 of a number, and escaped and null values are those of the folders. A
    partition was written if its folder holds files that were not there before.

    The wanted values are kept as a table of their own: its size is known, so a join
    with few of them skips the folders of all others.
    """
    names = view.partition_columns
    spark = stale.sparkSession
    due = partition_values(stale.where(F.col("view") == view.table_name()), view).withColumn("folder", partition_text(names))
    due = stored(due, scratch_path(spark, "due"))
    wanted = stored(due.select(*names).distinct(), scratch_path(spark, "wanted"))
    before = stored(_files(spark, path), scratch_path(spark, "files"))
    insert_dynamically_into(build(wanted), view, path)
    filled = _files(spark, path).join(before, ["folder", "file"], "left_anti").select("folder").distinct()
    outcome = checkpointed(
        due.join(filled.withColumn("has_data", F.lit(True)), "folder", "left").withColumn(
            "has_data", F.coalesce("has_data", F.lit(False))
        )
    )
    # Emptying a partition takes two calls on its folder and no job.
    for partition in outcome.where("NOT has_data").select("folder").distinct().toLocalIterator():
        folder = f"{path.rstrip('/')}/{partition.folder}"
        remove_folder(spark, folder)
        file_system(spark, folder).mkdirs(hadoop_path(spark, folder))
    outcome = outcome.select(F.lit(view.table_name()).alias("view"), "partition", "has_data")
    append_state(
        outcome.where("has_data").withColumns({"checksum": F.lit(checksum), "ts": F.lit(now)}), state_path, now
    )
    return outcome
