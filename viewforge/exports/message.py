"""Export to message topics: JSON or Avro values."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.exports.common import BATCH_ROWS, WRITERS, batches, check_key_and_value, observed, send_all
from viewforge.functions.avro import encode_rows
from viewforge.functions.digests import DEFAULT_SALT, anonymize, is_complex

# Message types of primitive columns, and the topic defaults.
MESSAGE_TYPES = {
    "boolean": "boolean",
    "int": "int",
    "string": "string",
    "bigint": "long",
    "float": "float",
    "double": "double",
    "tinyint": "int",
}
NAMESPACE = "viewforge.export"
TOPIC_PARTITIONS = 3
REPLICATION = 1
COMPRESSION = "gzip"


def _java_hash(text: str) -> int:
    value = 0
    for unit in memoryview(text.encode("utf-16-be")).cast("B").tobytes().hex(" ", 2).split():
        value = (31 * value + int(unit, 16)) & 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def message_schema(schema: T.StructType, name: str, private: Sequence[str] = ()) -> dict:
    """The record schema: every field is a union with null, null by default.

    Hashed columns are strings; a struct without a field name is called
    ``record_`` and a number made from its type text.
    """

    def union(inner) -> list:
        return ["null", inner]

    def of_type(data_type: T.DataType, field_name: str | None):
        if isinstance(data_type, T.MapType):
            return union({"type": "map", "values": of_type(data_type.valueType, None)})
        if isinstance(data_type, T.ArrayType):
            return union({"type": "array", "items": of_type(data_type.elementType, None)})
        if isinstance(data_type, T.StructType):
            label = field_name or f"record_{_java_hash(data_type.simpleString()) + 2147483647}"
            return union(record(data_type, label))
        if field_name in private:
            return union("string")
        kind = data_type.simpleString()
        if kind not in MESSAGE_TYPES:
            raise ValueError(f"no message type for {kind}")
        return union(MESSAGE_TYPES[kind])

    def record(struct_type: T.StructType, label: str) -> dict:
        return {
            "type": "record",
            "name": label,
            "namespace": NAMESPACE,
            "doc": struct_type.simpleString(),
            "fields": [
                {
                    "name": f.name,
                    "type": of_type(f.dataType, f.name),
                    "doc": f.dataType.simpleString(),
                    "default": None,
                }
                for f in struct_type
            ],
        }

    return record(schema, name)


def _flat_type(data_type: T.DataType) -> T.DataType:
    """The innermost element type below any number of arrays."""
    while isinstance(data_type, T.ArrayType):
        data_type = data_type.elementType
    return data_type


def compacted(value: Column, data_type: T.DataType) -> Column:
    """Nested arrays flattened, nulls dropped from arrays and maps, at every depth."""
    if isinstance(data_type, T.ArrayType):
        element = data_type.elementType
        while isinstance(element, T.ArrayType):
            value = F.flatten(F.filter(value, lambda x: x.isNotNull()))
            element = element.elementType
        present = F.filter(value, lambda x: x.isNotNull())
        return F.transform(present, lambda x: compacted(x, element)) if is_complex(element) else present
    if isinstance(data_type, T.MapType):
        present = F.map_filter(value, lambda _, v: v.isNotNull())
        if is_complex(data_type.valueType):
            return F.transform_values(present, lambda _, v: compacted(v, data_type.valueType))
        return present
    if isinstance(data_type, T.StructType):
        members = F.struct(*(compacted(value.getField(f.name), f.dataType).alias(f.name) for f in data_type))
        return F.when(value.isNotNull(), members)
    return value


def message_columns(
    df: DataFrame, private: Sequence[str] = (), salt: str = DEFAULT_SALT
) -> DataFrame:
    plain = anonymize(df, private, salt)
    return plain.select(*(compacted(F.col(f.name), f.dataType).alias(f.name) for f in plain.schema))


def message_encode(
    df: DataFrame, key: str, private: Sequence[str] = (), salt: str = DEFAULT_SALT
) -> DataFrame:
    """``key, value`` with the row as JSON; null columns stay null. The key is not hashed."""
    check_key_and_value(df.schema, key)
    rows = message_columns(df.withColumn("_key", F.col(key).cast("string")), private, salt)
    return rows.select(F.col("_key").alias("key"), json_body(df.columns).alias("value"))


def json_body(columns: Sequence[str]) -> Column:
    """The named columns as one JSON object, null members included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- binary values


def _flattened_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.ArrayType(_flat_type(f.dataType)))
            if isinstance(f.dataType, T.ArrayType)
            else T.StructField(f.name, f.dataType)
            for f in schema
        ]
    )


def message_encode_avro(
    df: DataFrame, key: str, name: str, private: Sequence[str] = (), salt: str = DEFAULT_SALT, columns_only: bool = False
) -> DataFrame:
    """``key, value`` with the row in binary.

    By Spark's own function where its Avro module is installed; otherwise, or with
    ``columns_only``, whole Arrow columns are encoded inside the tasks.
    """
    check_key_and_value(df.schema, key)
    keyed = df.withColumn("_key", F.col(key).cast("string"))
    rows = message_columns(keyed, private, salt)
    columns = df.columns
    schema = message_schema(_flattened_schema(T.StructType([rows.schema[c] for c in columns])), name, private)
    if not columns_only and has_avro_module(df.sparkSession):
        from pyspark.sql.avro.functions import to_avro

        return rows.select(F.col("_key").alias("key"), to_avro(F.struct(*columns), json.dumps(schema)).alias("value"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = encode_rows([batch.column(c) for c in columns], schema).values()
            yield pa.RecordBatch.from_arrays([batch.column("_key"), values.cast(pa.binary())], ["key", "value"])

    return rows.mapInArrow(encode, "key string, value binary")


def has_avro_module(spark: SparkSession) -> bool:
    """Whether Spark's own Avro functions are installed."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.CatalystDataToAvro")
    except Py4JJavaError:
        return False
    return True


def topic_name(database: str, table: str) -> str:
    return f"{database}_{table}"


class MessageClient(Protocol):
    def send(self, topic: str, items: Sequence[tuple[str, object]]) -> None: ...

    def flush(self) -> None: ...

    def close(self) -> None: ...


def message_write(
    encoded: DataFrame,
    topic: str,
    client_factory: Callable[[], MessageClient] | None = None,
    options: dict[str, str] | None = None,
    writers: int = WRITERS,
    batch_rows: int = BATCH_ROWS,
    synchronous: bool = True,
) -> dict[str, int]:
    """Send to a topic, with the Kafka connector or with an own client.

    Delivery is at least once: a repeated task sends its messages again. Returns how many were sent with and without a value.
    """
    rows = encoded.repartition(writers)
    if client_factory is None:
        settings = {"topic": topic, "kafka.compression.type": COMPRESSION, **(options or {})}
        rows, seen = observed(rows, "value")
        rows.write.format("kafka").options(**settings).save()
        return seen.get

    def send(part):
        client = client_factory()
        try:
            for batch in batches(part, batch_rows):
                client.send(topic, [(r["key"], r["value"]) for r in batch])
                if synchronous:
                    client.flush()
                yield batch
            client.flush()
        finally:
            client.close()

    return send_all(rows, send)
