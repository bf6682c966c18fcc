"""Session settings, shared scratch space and lineage cutting."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import cache
from pathlib import Path
from types import ModuleType

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "viewforge", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; keyword values win.

    Shuffle partitions are left to the cluster: adaptive execution coalesces
    them, splits skewed join partitions and re-plans joins from real sizes.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_packages(spark: SparkSession, *packages: ModuleType) -> None:
    """Give the Python workers these packages, once per Spark application.

    Needed where they are not installed on the workers. The archive travels with
    the application's files, as with ``--py-files``.
    """
    context = spark.sparkContext
    missing = [p for p in packages if (context.applicationId, p.__name__) not in _SHIPPED]
    if missing:
        context.addPyFile(_archive(spark, missing))
        _SHIPPED.update((context.applicationId, p.__name__) for p in missing)


_SHIPPED: set[tuple[str, str]] = set()


def _archive(spark: SparkSession, packages: Sequence[ModuleType]) -> str:
    """The packages as one archive in the shared folder."""
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for package in packages:
            root = Path(package.__path__[0])
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
    target = f"{scratch_path(spark, 'code')}/{'_'.join(p.__name__ for p in packages)}.zip"
    out = file_system(spark, target).create(hadoop_path(spark, target))
    out.write(content.getvalue())
    out.close()
    return target


def hadoop_path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str) -> JavaObject:
    """The Hadoop file system that holds the path, for work on names alone."""
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(hadoop_path(spark, path), True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of its own, because there every task sees the same disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="viewforge-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    Used once per round of the iterative operators, so a lost executor costs at
    most one round and the plan does not grow with the number of rounds.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a table under ``path`` and read back: compressed, read by column, of known size."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
