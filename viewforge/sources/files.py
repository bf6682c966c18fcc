"""File ingestion and distributed copying."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import viewforge
from viewforge.model import ViewDef
from viewforge.session import checkpointed, file_system, hadoop_path, ship_packages
from viewforge.sources.formats import read_view, write_view
from viewforge.sources.uris import open_uri


def read_tsv(spark: SparkSession, view: ViewDef, path: str) -> DataFrame:
    """A tab separated stage file with the declared types; quotes are characters like all others."""
    return spark.read.schema(view.schema).csv(path, sep="\t", nullValue="\\N", quote="")


def ingest_files(
    spark: SparkSession,
    source: str,
    view: ViewDef,
    target: str,
    recursive: bool = True,
    source_view: ViewDef | None = None,
) -> DataFrame:
    """Load the files under ``source`` and store them as ``view`` at ``target``.

    The files have the format that ``source_view`` declares; without one, those of a recursive load are tab
    separated text without quotes. Folders whose name starts with a dot or an underscore are skipped, as in any
    Spark file listing.
    """
    if recursive and source_view is None:
        reader = spark.read.option("recursiveFileLookup", "true").schema(view.data_schema)
        rows = reader.csv(source, sep="\t", nullValue="\\N", quote="")
    elif recursive:
        rows = read_view(spark, replace(source_view, partitions=()), source, recursive=True)
    else:
        rows = read_view(spark, source_view or view, source)
    write_view(rows, view, target)
    return read_view(spark, view, target)


# ---------------------------------------------------------------- copying

STATUS_SCHEMA = "source string, target string, action string, bytes long, error string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative, length, modified`` of every file; file contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    base = _normalised(spark, root)
    return listed.withColumn("relative", F.expr(f"substring(path, {len(base) + 2})"))


def _normalised(spark: SparkSession, path: str) -> str:
    """The path as file listings spell it, scheme included."""
    return file_system(spark, path).makeQualified(hadoop_path(spark, path)).toString().rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(hadoop_path(spark, path))


FILE_SCHEMA = "base string, relative string, folder boolean, length long, modified long"


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each folder holds, one level down."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            store, path = open_uri(f"{row.base}/{row.relative}" if row.relative else row.base)
            found = store.get_file_info(fs.FileSelector(path))
            before = f"{row.relative}/" if row.relative else ""
            yield pd.DataFrame(
                [
                    (row.base, before + i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000)
                    for i in found
                ],
                columns=["base", "relative", "folder", "length", "modified"],
            )


def list_all_files(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """``path, relative, length, modified`` of every file, those with a dot or an underscore before their name included.

    A source is a folder, a file or a pattern. Paths are relative to a folder, and to the folder around a file or
    what a pattern matches. Folders are listed in tasks, one job per level.
    """
    ship_packages(spark, viewforge)
    roots = []
    for source in sources:
        store = file_system(spark, source)
        plain = _exists(spark, source)
        matched = [store.getFileStatus(hadoop_path(spark, source))] if plain else list(store.globStatus(hadoop_path(spark, source)) or [])
        if not matched:
            raise FileNotFoundError(source)
        for status in matched:
            base, _, name = status.getPath().toString().rstrip("/").rpartition("/")
            if status.isFile() or not plain:
                roots.append((base, name, status.isDirectory(), status.getLen(), status.getModificationTime() * 1000))
            else:
                roots.append((f"{base}/{name}", "", True, 0, 0))
    level = spark.createDataFrame(roots, FILE_SCHEMA)
    levels = [level]
    while not (folders := level.where("folder")).isEmpty():
        level = checkpointed(folders.repartition("base", "relative").mapInPandas(_children, FILE_SCHEMA))
        levels.append(level)
    files = reduce(DataFrame.unionByName, levels).where("NOT folder")
    return files.select(F.concat_ws("/", "base", "relative").alias("path"), "relative", "length", "modified")


def copy_file(source: str, target: str) -> int:
    """Stream one file to a temporary name, then rename: a repeated task is harmless."""
    source_fs, source_path = open_uri(source)
    target_fs, target_path = open_uri(target)
    target_fs.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
    partial = f"{target_path}.{uuid.uuid4().hex}.part"
    copied = 0
    with (
        source_fs.open_input_stream(source_path, compression=None) as reader,
        target_fs.open_output_stream(partial, compression=None) as writer,
    ):
        while chunk := reader.read(8 << 20):
            writer.write(chunk)
            copied += len(chunk)
    target_fs.move(partial, target_path)
    return copied


def _apply(ignore_failures: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                copied, error = 0, None
                try:
                    if row.action == "copy":
                        copied = copy_file(row.source, row.target)
                    elif row.action == "delete":
                        target_fs, target_path = open_uri(row.target)
                        target_fs.delete_file(target_path)
                except (OSError, FileNotFoundError) as problem:
                    if not ignore_failures:
                        raise
                    error = str(problem)
                rows.append((row.source, row.target, row.action, copied, error))
            yield pd.DataFrame(rows, columns=["source", "target", "action", "bytes", "error"])

    return run


def copy_plan(
    spark: SparkSession,
    sources: Sequence[str],
    target: str,
    update: bool = False,
    overwrite: bool = False,
    delete_missing: bool = False,
) -> DataFrame:
    """What a copy would do: ``source, target, action, length`` with action copy, skip or delete.

    Without options only files missing at the target are copied. ``update`` also
    copies files whose size differs or whose source is newer; ``overwrite``
    copies everything. Several files for one target are refused.
    """
    base = _normalised(spark, target)
    wanted = checkpointed(list_all_files(spark, sources)).select(
        F.col("path").alias("source"), "relative", "length", F.col("modified").alias("source_modified")
    )
    if several := wanted.groupBy("relative").count().where("count > 1").select("relative").head(3):
        raise ValueError(f"several files for one target: {', '.join(r[0] for r in several)}")
    if not _exists(spark, target):
        return wanted.select(
            "source", F.concat(F.lit(base + "/"), "relative").alias("target"), F.lit("copy").alias("action"), "length"
        )
    present = list_all_files(spark, [target]).select(
        F.col("path").alias("present_path"),
        "relative",
        F.col("length").alias("present_length"),
        F.col("modified").alias("present_modified"),
    )
    joined = wanted.join(present, "relative", "full" if delete_missing else "left")
    changed = (F.col("length") != F.col("present_length")) | (F.col("source_modified") > F.col("present_modified"))
    action = (
        F.when(F.col("source").isNull(), "delete")
        .when(F.lit(overwrite) | F.col("present_path").isNull(), "copy")
        .when(F.lit(update) & changed, "copy")
        .otherwise("skip")
    )
    return joined.select(
        "source", F.concat(F.lit(base + "/"), "relative").alias("target"), action.alias("action"), "length"
    )


#: What a file costs beside its bytes.
FILE_WEIGHT = 1 << 20


def copy_tasks(plan: DataFrame, max_tasks: int) -> DataFrame:
    """``plan`` with the ``task`` of each row: neighbours of about equal bytes together, by a running sum over all rows.

    The sum runs within each partition of the plan; the driver adds up one total per partition.
    """
    weight = F.when(F.col("action") == "copy", F.col("length") + FILE_WEIGHT).otherwise(1).cast("long")
    rows = checkpointed(plan.withColumn("weight", weight).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("weight").alias("n")).orderBy("part").collect()
    ends = list(accumulate(t["n"] for t in totals))
    before = plan.sparkSession.createDataFrame([(t["part"], e - t["n"]) for t, e in zip(totals, ends, strict=True)], "part int, before long")
    running = F.sum("weight").over(Window.partitionBy("part").orderBy("target").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("before") + F.col("running") - F.col("weight") / 2
    task = F.least(F.floor(middle * max_tasks / max(1, ends[-1] if ends else 1)), F.lit(max_tasks - 1)).cast("int")
    return rows.withColumn("running", running).join(before, "part").select(*plan.columns, task.alias("task"))


def distributed_copy(
    spark: SparkSession,
    sources: Sequence[str],
    target: str,
    update: bool = False,
    overwrite: bool = False,
    delete_missing: bool = False,
    ignore_failures: bool = False,
    max_tasks: int = 20,
) -> DataFrame:
    """Copy files in up to ``max_tasks`` tasks of about equal bytes; one status row per file, copies already done."""
    plan = copy_plan(spark, sources, target, update, overwrite, delete_missing)
    work = copy_tasks(plan, max_tasks).repartitionById(max_tasks, "task").select("source", "target", "action")
    return checkpointed(work.mapInPandas(_apply(ignore_failures), STATUS_SCHEMA))


def distributed_copy_to_view(
    spark: SparkSession, source: str, table_path: str, partition_path: str = "", **options
) -> DataFrame:
    """Copy one folder or file, name included, beside the view's own folder (its parent path)."""
    full = f"{table_path}{partition_path}".rstrip("/")
    parent = full.rsplit("/", 1)[0]
    single = file_system(spark, source).getFileStatus(hadoop_path(spark, source)).isFile()
    leaf = "" if single else "/" + source.rstrip("/").rsplit("/", 1)[1]
    return distributed_copy(spark, [source], f"{parent}{leaf}", **options)
