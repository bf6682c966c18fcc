"""Export to a cloud warehouse: JSON lines in storage, then a load into one table partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.exports.common import observed
from viewforge.functions.digests import DEFAULT_SALT, anonymize, json_text

# The filter column and the warehouse type names.
FILTER_COLUMN = "_USED_HCAT_FILTER"
WAREHOUSE_TYPES = {
    "int": "INTEGER",
    "bigint": "INTEGER",
    "tinyint": "INTEGER",
    "float": "FLOAT",
    "double": "FLOAT",
    "boolean": "BOOLEAN",
}
DATE_COLUMNS = ("year", "month", "day", "date_id", "month_id")


def warehouse_schema(schema: T.StructType) -> list[dict]:
    """Column descriptions: name, type, mode, and nested fields for records."""

    def described(f: T.StructField) -> dict:
        data_type, mode = f.dataType, "NULLABLE"
        if isinstance(data_type, T.ArrayType):
            data_type, mode = data_type.elementType, "REPEATED"
        if isinstance(data_type, T.StructType):
            return {"name": f.name, "type": "RECORD", "mode": mode, "fields": [described(m) for m in data_type]}
        return {"name": f.name, "type": WAREHOUSE_TYPES.get(data_type.simpleString(), "STRING"), "mode": mode}

    return [{"name": FILTER_COLUMN, "type": "STRING", "mode": "NULLABLE"}, *(described(f) for f in schema)]


def _rendered(value: Column, data_type: T.DataType) -> Column:
    """Maps, and arrays or maps inside arrays, become JSON text; records keep their shape."""
    if isinstance(data_type, T.MapType):
        return json_text(value)
    if isinstance(data_type, T.StructType):
        members = F.struct(*(_rendered(value.getField(f.name), f.dataType).alias(f.name) for f in data_type))
        return F.when(value.isNotNull(), members)
    if isinstance(data_type, T.ArrayType):
        element = data_type.elementType
        if isinstance(element, (T.MapType, T.ArrayType)):
            return F.transform(value, json_text)
        if isinstance(element, T.StructType):
            return F.transform(value, lambda x: _rendered(x, element))
    return value


def warehouse_encode(
    df: DataFrame, filter_text: str | None = None, private: Sequence[str] = (), salt: str = DEFAULT_SALT
) -> DataFrame:
    """One JSON line per row, nulls left out, the filter added, private columns hashed."""
    plain = anonymize(df, private, salt)
    used = F.lit(filter_text).cast("string").alias(FILTER_COLUMN)
    columns = [_rendered(F.col(f.name), f.dataType).alias(f.name) for f in plain.schema]
    return plain.select(F.to_json(F.struct(used, *columns)).alias("value"))


def warehouse_target_columns(table: str, partition_columns: Sequence[str]) -> Column:
    """``<table>_<suffix>$<date>`` per row of partition values.

    The date is ``date_id``, or ``month_id`` with ``01`` appended; the other
    columns that are not dates form the suffix, sorted by name.
    """
    suffix = [F.col(c).cast("string") for c in sorted(partition_columns) if c not in DATE_COLUMNS]
    name = F.concat(F.lit(f"{table}_"), F.lower(F.concat_ws("_", *suffix))) if suffix else F.lit(table)
    for column in partition_columns:
        if column == "month_id":
            return F.concat(name, F.lit("$"), F.col(column), F.lit("01"))
        if column == "date_id":
            return F.concat(name, F.lit("$"), F.col(column))
    return name


def warehouse_target(table: str, params: Mapping[str, object]) -> str:
    """The same name from one partition's values."""
    suffix = "_".join(str(params[c]) for c in sorted(params) if c not in DATE_COLUMNS).lower()
    name = f"{table}_{suffix}" if suffix else table
    for column, value in params.items():
        if column in ("month_id", "date_id"):
            return f"{name}${value}01" if column == "month_id" else f"{name}${value}"
    return name


class WarehouseClient(Protocol):
    def drop_partition(self, target: str) -> None: ...

    def create_table(self, target: str, schema: list[dict]) -> None: ...

    def load(self, target: str, location: str) -> None: ...

    def remove_files(self, location: str) -> None: ...


def warehouse_write(
    df: DataFrame,
    location: str,
    target: str,
    client: WarehouseClient,
    filter_text: str | None = None,
    private: Sequence[str] = (),
    salt: str = DEFAULT_SALT,
    writers: int | None = None,
) -> dict[str, int]:
    """Store compressed JSON lines, replace the target partition by them, remove the files. Returns how many rows were written.

    One file per partition of the frame, or ``writers`` files after a shuffle. The
    files are complete before the target is touched, so an error until then leaves it as it is. A later error
    drops what was loaded, so the partition is never half filled.
    """
    plain = anonymize(df, private, salt)
    touched = False
    try:
        lines = warehouse_encode(df, filter_text, private, salt)
        lines, seen = observed(lines.repartition(writers) if writers else lines)
        lines.write.mode("overwrite").option("compression", "gzip").text(location)
        touched = True
        client.drop_partition(target)
        client.create_table(target, warehouse_schema(plain.schema))
        client.load(target, location)
        return seen.get
    except Exception:
        if touched:
            client.drop_partition(target)
        raise
    finally:
        client.remove_files(location)
