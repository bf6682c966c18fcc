"""A versioned table of partition state: sorted runs of rows under a manifest that is replaced atomically.

Under the table's folder lie ``data/`` with one Parquet folder per run and ``manifest/``
with one small JSON file per version, which lists the runs of that version, oldest and
largest first. A commit writes a run and then the next version; whoever names that
version second fails to rename and tries again on top of it. Runs are merged by size as
in a log-structured tree: every run is more than twice as large as all later ones
together, so there are at most some log2 of the number of rows, whatever the number of
commits, and a row is rewritten as often. What a lost commit or merge has written is
named by no version and so never read; :func:`vacuum` removes it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from viewforge.session import file_system, hadoop_path

KEY = ["view", "partition"]
STATE_SCHEMA = "view string, partition string, checksum string, ts long, seq long"
#: Times that a version is tried to be named, and seconds before a run that no version names counts as lost.
ATTEMPTS, GRACE_SECONDS = 50, 24 * 3600


@dataclass(frozen=True)
class Run:
    """A folder of rows, one per partition, and their number."""

    name: str
    rows: int


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = hadoop_path(spark, f"{path}/manifest")
    system = file_system(spark, path)
    if not system.exists(folder):
        return []
    names = (status.getPath().getName() for status in system.listStatus(folder))
    return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/manifest/{version:012d}.json"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[Run]]:
    """A version and its runs; the newest one, or version 0 without runs where nothing was committed."""
    if version is None:
        versions = _versions(spark, path)
        if not versions:
            return 0, []
        version = versions[-1]
    at = hadoop_path(spark, _manifest_path(path, version))
    stream = file_system(spark, path).open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, [Run(**run) for run in json.loads(text)["runs"]]


def _name_version(spark: SparkSession, path: str, version: int, runs: Sequence[Run]) -> bool:
    """Write a version beside its place and rename it; False if another one has that place."""
    system, target = file_system(spark, path), hadoop_path(spark, _manifest_path(path, version))
    draft = hadoop_path(spark, f"{path}/manifest/.{version}-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(json.dumps({"runs": [asdict(r) for r in runs]}).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, no_options)
    except Exception as error:  # the gateway wraps Java's exceptions
        system.delete(draft, False)
        if system.exists(target):
            return False
        raise error
    return True


def _change(spark: SparkSession, path: str, change: Callable[[list[Run]], list[Run] | None]) -> int | None:
    """Name a new version with the changed runs of the newest one; None if there is nothing to change any more."""
    for _ in range(ATTEMPTS):
        version, runs = manifest(spark, path)
        new = change(runs)
        if new is None:
            return None
        if _name_version(spark, path, version + 1, new):
            return version + 1
    raise RuntimeError(f"{path}: other writers named {ATTEMPTS} versions in a row first")


def _written(df: DataFrame, path: str) -> Run:
    name, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/data/{name}")
    return Run(name, seen.get["n"])


def _newest(rows: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("checksum", "ts", "seq"), F.struct("seq", "ts", "checksum"))
    return rows.groupBy(*KEY).agg(latest.alias("latest")).select(*KEY, "latest.checksum", "latest.ts", "latest.seq")


def _rows(spark: SparkSession, path: str, runs: Sequence[Run]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(*(f"{path}/data/{r.name}" for r in runs))


def due_for_merge(sizes: Sequence[int]) -> int:
    """Number of the first run that is not more than twice as large as all later ones together; the length if all are."""
    later, first = 0, len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if later and sizes[i] <= 2 * later:
            first = i
        later += sizes[i]
    return first


def commit(updates: DataFrame, path: str, seq: int) -> int:
    """Add ``view, partition, checksum, ts`` rows under the number ``seq``; the version that holds them.

    Of rows for the same partition the one with the greatest ``seq`` counts, then the
    latest, so commits may arrive in any order. No rows make no version.
    """
    spark, path = updates.sparkSession, path.rstrip("/")
    rows = updates.select(*KEY, "checksum", F.col("ts").cast("long"), F.lit(seq).cast("long").alias("seq"))
    run = _written(_newest(rows), path)
    if not run.rows:
        return manifest(spark, path)[0]
    version = _change(spark, path, lambda runs: [*runs, run])
    merge(spark, path)
    return version


def merge(spark: SparkSession, path: str, everything: bool = False) -> int | None:
    """Merge the runs that are due, or all; None if there were none or another writer was faster.

    Runs that others add meanwhile stay behind the merged one. If one of the merged runs
    is no longer there, somebody else has merged it, and this merge changes nothing.
    """
    path = path.rstrip("/")
    _, runs = manifest(spark, path)
    first = 0 if everything else due_for_merge([r.rows for r in runs])
    old = runs[first:]
    if len(old) < 2:
        return None
    merged = _written(_newest(_rows(spark, path, old)), path)

    def replaced(now: list[Run]) -> list[Run] | None:
        if not set(old) <= set(now):
            return None
        at = now.index(old[0])
        return [*now[:at], merged, *(r for r in now[at:] if r not in old)]

    return _change(spark, path, replaced)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``view, partition, checksum, ts`` as of a version, the newest one by default."""
    path = path.rstrip("/")
    return _newest(_rows(spark, path, manifest(spark, path, version)[1])).drop("seq")


def vacuum(spark: SparkSession, path: str, keep: int = 10, older_than: float = GRACE_SECONDS) -> None:
    """Remove all but the last ``keep`` versions, and runs that none of these names if they are old enough.

    ``older_than`` has to be longer than any commit or merge takes between writing its run and naming its version.
    """
    path = path.rstrip("/")
    system = file_system(spark, path)
    versions = _versions(spark, path)
    named = {run.name for v in versions[-keep:] for run in manifest(spark, path, v)[1]}
    for version in versions[:-keep]:
        system.delete(hadoop_path(spark, _manifest_path(path, version)), False)
    data = hadoop_path(spark, f"{path}/data")
    for status in system.listStatus(data) if system.exists(data) else []:
        old = status.getModificationTime() <= (time.time() - older_than) * 1000
        if old and status.getPath().getName() not in named:
            system.delete(status.getPath(), True)
