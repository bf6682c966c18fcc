"""Helpers on frames shared by the operators: packed rows, text keys, shared tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import viewforge
from viewforge.session import scratch_path, ship_packages

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: 64-bit words of a sieve, whatever the number of keys.
SIEVE = 1 << 18
#: Rows of a file of a table whose rows are small, and files that any such table may have.
FILE_ROWS, FEW = 10_000, 8


def quoted(name: str) -> Column:
    """A column by its plain name, dots and back ticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside ``columns``, so that no name of the table can clash with ours."""
    return docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, names: Sequence[str], new: Sequence[str]) -> DataFrame:
    """The columns ``names`` of the packed rows and the ``new`` ones, which replace old ones of that name."""
    kept = (F.col("row").getField(n).alias(n) for n in names if n not in new)
    return df.select(*kept, *new)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null for null."""
    return F.unhex(F.md5(text))


def shared_table(df: DataFrame, label: str, rows: int | None = None, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage cut, size known, column by column.

    ``rows`` is for small rows whose number is known to be some such: the table gets a file for each ``FILE_ROWS`` of them.
    """
    path = scratch_path(df.sparkSession, label)
    few = df if rows is None else df.coalesce(max(FEW, rows // FILE_ROWS))
    few.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sieved(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among those of ``keys``, a stored table: all that are, and a share of the others.

    Before an exact join this spares the shuffle of rows without a partner. The sieve is a bit for each hash, of fixed size:
    a million keys let one in sixteen of the others through, and where it fills up, nothing is lost but the saving.
    """
    spread = F.xxhash64(quoted(column))
    word, place = F.pmod(spread, F.lit(SIEVE)).cast("int"), F.shiftrightunsigned(spread, 58).cast("int")
    bits = F.expr("bit_or(shiftleft(1L, place))").alias("bits")
    found = keys.select(word.alias("word"), place.alias("place")).groupBy("word").agg(bits).toArrow()
    words = np.zeros(SIEVE, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    sieve = df.sparkSession.createDataFrame(pa.table({"_sieve": pa.array([words], pa.list_(pa.int64()))}))
    return df.join(F.broadcast(sieve), F.getbit(F.get("_sieve", word), place) == 1, "left_semi")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ready(spark: SparkSession) -> None:
    """Give the Python workers this package; nothing is done where it already travels with the application."""
    ship_packages(spark, viewforge)
