"""Export to key-value stores: strings, hashes, lists, whole rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.exports.common import BATCH_ROWS, WRITERS, batches, check_key_and_value, send_all
from viewforge.functions.digests import DEFAULT_SALT, anonymize, hashed, is_complex, json_text


def _key(df: DataFrame, key: str, prefix: str | None) -> Column:
    """The key is never hashed, so that readers can find it."""
    text = F.col(key).cast("string")
    return (F.concat(F.lit(f"{prefix}_"), text) if prefix else text).alias("key")


def kv_encode_string(
    df: DataFrame,
    key: str,
    value: str,
    prefix: str | None = None,
    private: Sequence[str] = (),
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    check_key_and_value(df.schema, key, value)
    text = hashed(F.col(value), salt) if value in private else F.col(value).cast("string")
    return df.where(F.col(value).isNotNull()).select(_key(df, key, prefix), text.alias("value"))


def kv_encode_hash(df: DataFrame, key: str, value: str, prefix: str | None = None) -> DataFrame:
    """A map keeps null members as the text ``null``; a struct leaves them out."""
    check_key_and_value(df.schema, key, value)
    data_type = df.schema[value].dataType
    rows = df.where(F.col(value).isNotNull())
    if isinstance(data_type, T.StructType):
        entries = F.array(
            *(
                F.struct(F.lit(f.name).alias("key"), F.col(value).getField(f.name).cast("string").alias("value"))
                for f in data_type
            )
        )
        fields = F.map_from_entries(F.filter(entries, lambda e: e.getField("value").isNotNull()))
        return rows.select(_key(df, key, prefix), fields.alias("value")).where(F.size("value") > 0)
    fields = F.map_from_entries(
        F.transform(
            F.map_entries(F.col(value)),
            lambda e: F.struct(
                e.getField("key").cast("string").alias("key"),
                F.coalesce(e.getField("value").cast("string"), F.lit("null")).alias("value"),
            ),
        )
    )
    return rows.select(_key(df, key, prefix), fields.alias("value"))


def kv_encode_list(df: DataFrame, key: str, value: str, prefix: str | None = None) -> DataFrame:
    """Items are pushed to the head one by one, so the stored list is the reverse."""
    check_key_and_value(df.schema, key, value)
    return df.where(F.col(value).isNotNull()).select(
        _key(df, key, prefix), F.reverse(F.col(value).cast("array<string>")).alias("value")
    )


def kv_encode_row(
    df: DataFrame, key: str, prefix: str | None = None, private: Sequence[str] = (), salt: str = DEFAULT_SALT
) -> DataFrame:
    """The whole row as a hash without null columns; complex columns as JSON."""
    check_key_and_value(df.schema, key)
    plain = anonymize(df.withColumn("_key", _key(df, key, prefix)), private, salt)
    entries = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("key"),
                (json_text(F.col(f.name)) if is_complex(f.dataType) else F.col(f.name).cast("string")).alias("value"),
            )
            for f in plain.schema
            if f.name != "_key"
        )
    )
    fields = F.map_from_entries(F.filter(entries, lambda e: e.getField("value").isNotNull()))
    return plain.select(F.col("_key").alias("key"), fields.alias("value")).where(F.size("value") > 0)


class KeyValueClient(Protocol):
    def delete(self, keys: Sequence[str]) -> None: ...

    def put(self, items: Sequence[tuple[str, object]]) -> None: ...

    def close(self) -> None: ...


def kv_write(
    encoded: DataFrame,
    client_factory: Callable[[], KeyValueClient],
    replace: bool = True,
    writers: int = WRITERS,
    batch_rows: int = BATCH_ROWS,
    flush: Callable[[], None] | None = None,
) -> dict[str, int]:
    """Send ``key, value`` rows in pipelined batches; returns how many were sent with and without a value.

    Rows spread evenly over the writers, so a hot key does not slow one of them
    down. With ``replace`` one row of each key is sent, the one whose value is the
    greatest as JSON text, so neither batches nor writers nor a repeated task change
    the store. Without it, all rows are sent in no certain order, and appended list
    items may repeat when a task does.
    """
    if replace:
        order = F.to_json(F.struct("value"))
        encoded = encoded.groupBy("key").agg(F.max_by("value", order).alias("value"))
    if flush is not None:
        flush()

    def send(rows):
        client = client_factory()
        try:
            for batch in batches(rows, batch_rows):
                if replace:
                    client.delete([r["key"] for r in batch])
                client.put([(r["key"], r["value"]) for r in batch])
                yield batch
        finally:
            client.close()

    return send_all(encoded.repartition(writers), send)
