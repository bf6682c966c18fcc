"""Export as delimited or JSON files and upload them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.exports.message import json_body, message_columns
from viewforge.exports.common import observed
from viewforge.functions.digests import DEFAULT_SALT, anonymize, complex_to_json
from viewforge.session import checkpointed, remove_folder
from viewforge.sources.files import list_files

# Codecs and the file endings they give.
CODEC_ENDINGS = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}
STAMP_PATTERN = "%Y%m%d%H%M%S%f"


def csv_encode(df: DataFrame, private: Sequence[str] = (), salt: str = DEFAULT_SALT) -> DataFrame:
    """Every column as trimmed text, null as empty text, complex columns as JSON."""
    text = complex_to_json(anonymize(df, private, salt))
    return text.select(*(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in text.columns))


def export_csv(
    df: DataFrame,
    path: str,
    delimiter: str = "\t",
    header: bool = True,
    codec: str = "gzip",
    private: Sequence[str] = (),
    salt: str = DEFAULT_SALT,
    writers: int | None = None,
) -> dict[str, int]:
    """Quoted delimited files; an inner quote is doubled. Returns how many rows were written.

    One file per partition of the frame, or ``writers`` files after a shuffle.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter has to be one character")
    if codec not in CODEC_ENDINGS:
        raise ValueError(f"codec has to be one of {sorted(CODEC_ENDINGS)}")
    rows = csv_encode(df, private, salt)
    rows, seen = observed(rows.repartition(writers) if writers else rows)
    rows.write.mode("overwrite").options(
        sep=delimiter, header=str(header).lower(), quoteAll="true", escape='"', emptyValue="", compression=codec
    ).csv(path)
    return seen.get


def json_lines_encode(df: DataFrame, private: Sequence[str] = (), salt: str = DEFAULT_SALT) -> DataFrame:
    return message_columns(df, private, salt).select(json_body(df.columns).alias("value"))


def export_json_lines(
    df: DataFrame,
    path: str,
    codec: str = "gzip",
    private: Sequence[str] = (),
    salt: str = DEFAULT_SALT,
    writers: int | None = None,
) -> dict[str, int]:
    """One JSON text per line. Returns how many rows were written."""
    rows = json_lines_encode(df, private, salt)
    rows, seen = observed(rows.repartition(writers) if writers else rows)
    rows.write.mode("overwrite").option("compression", codec).text(path)
    return seen.get


def _spread(files: DataFrame, writers: int | None) -> DataFrame:
    """File names over many tasks. The number is given: adaptive execution would merge so few bytes into one task."""
    return files.repartition(writers or files.sparkSession.sparkContext.defaultParallelism)


def remote_prefix(database: str, table: str) -> str:
    return f"{database}-{table}"


def upload_files(
    df: DataFrame,
    scratch: str,
    uploader_factory: Callable[[], Callable[[str, str], None]],
    prefix: str,
    at: datetime,
    kind: str = "csv",
    codec: str = "gzip",
    writers: int | None = None,
    **options,
) -> DataFrame:
    """Write files under ``scratch``, one per partition or per writer, then send each once.

    ``uploader_factory()`` gives a function ``(file uri, remote name)``. Remote
    names are ``<prefix>-<UTC time>-<task>-<n><ending>``, where a task numbers its
    files from 0, and depend only on the file, so a repeated task overwrites its own upload. Returns one row per file:
    ``source, remote``. The scratch folder is removed afterwards.
    """
    spark = df.sparkSession
    if kind == "csv":
        export_csv(df, scratch, codec=codec, writers=writers, **options)
    elif kind == "json":
        export_json_lines(df, scratch, codec=codec, writers=writers, **options)
    else:
        raise ValueError("kind has to be csv or json")
    stem = f"{prefix}-{at.strftime(STAMP_PATTERN)[:17]}"
    ending = f".{kind}{CODEC_ENDINGS[codec]}"
    files = list_files(spark, scratch).select(
        F.col("path").alias("source"),
        F.concat(
            F.lit(f"{stem}-"),
            F.regexp_extract("path", r"part-(\d+)-", 1),
            F.lit("-"),
            F.regexp_extract("path", r"-c(\d+)\.[^/]*$", 1).cast("int").cast("string"),
            F.lit(ending),
        ).alias("remote"),
    )

    def send(parts):
        uploader = uploader_factory()
        for part in parts:
            for source, remote in zip(part["source"], part["remote"]):
                uploader(source, remote)
            yield pd.DataFrame(part)

    sent = checkpointed(_spread(files, writers).mapInPandas(send, "source string, remote string"))
    remove_folder(spark, scratch)
    return sent
