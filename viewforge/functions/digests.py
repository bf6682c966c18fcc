"""Digests, anonymisation and JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
DEFAULT_SALT = "vD75MqvaasIlCf7H"
EMPTY_DIGEST = "0"


def digest(texts: Column) -> Column:
    """Upper-case MD5 of the sorted, joined texts of one row; ``"0"`` without any."""
    joined = F.array_join(F.sort_array(texts), "")
    return F.when(F.size(texts) > 0, F.upper(F.md5(joined))).otherwise(F.lit(EMPTY_DIGEST))


def digest_groups(df: DataFrame, group_columns: Sequence[str], text_column: str) -> DataFrame:
    """One order-free digest per group of any size.

    Sorting and joining the texts of a group would pull a hot group into one
    task. Instead every row is hashed where it lies and only the row count and
    two sums of hash halves travel, so partial aggregation leaves one small row
    per group and task. Equal multisets of texts give equal digests.
    Null texts do not count; a group without any text has the empty digest.
    """
    row_hash = F.md5(F.col(text_column))

    def half(start: int) -> Column:
        return F.conv(F.substring(row_hash, start, 16), 16, 10).cast("decimal(20,0)")

    sums = df.groupBy(*group_columns).agg(
        F.count(text_column).alias("n_texts"),
        F.sum(half(1)).cast("string").alias("low"),
        F.sum(half(17)).cast("string").alias("high"),
    )
    whole = F.upper(F.md5(F.concat_ws("-", F.col("n_texts").cast("string"), "low", "high")))
    return sums.select(*group_columns, "n_texts", F.when(F.col("n_texts") > 0, whole).otherwise(EMPTY_DIGEST).alias("digest"))


def hashed(value: Column, salt: str = DEFAULT_SALT) -> Column:
    """Lower-case MD5 of text and salt; null stays null."""
    return F.md5(F.concat(value.cast("string"), F.lit(salt)))


def is_complex(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))


def anonymize(df: DataFrame, columns: Sequence[str], salt: str = DEFAULT_SALT) -> DataFrame:
    """Hash the named top-level primitive columns; they become strings."""
    wanted = {c for c in columns if c in df.columns and not is_complex(df.schema[c].dataType)}
    return df.select(*(hashed(F.col(c), salt).alias(c) if c in wanted else F.col(c) for c in df.columns))


def json_text(value: Column) -> Column:
    """JSON of a complex value, null members included."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def complex_to_json(df: DataFrame) -> DataFrame:
    """Complex columns as JSON text, primitive columns as their text."""
    return df.select(
        *(
            (json_text(F.col(f.name)) if is_complex(f.dataType) else F.col(f.name).cast("string")).alias(f.name)
            for f in df.schema
        )
    )
