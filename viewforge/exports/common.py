"""What all exports share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.functions.digests import is_complex

# Writers and batch sizes used unless a caller says otherwise.
WRITERS = 10
FILE_WRITERS = 2
BATCH_ROWS = 10000


def partition_filter_text(params: Mapping[str, object]) -> str:
    """``p = 'v' and q = 'w'`` in the order given."""
    return " and ".join(f"{name} = '{value}'" for name, value in params.items())


def partition_filter_column(names: Sequence[str]) -> Column:
    """The same text built per row from partition columns."""
    parts = [F.concat(F.lit(f"{n} = '"), F.col(n).cast("string"), F.lit("'")) for n in names]
    return F.concat_ws(" and ", *parts)


def compact_filter(text: Column | str) -> Column:
    """The filter without blanks and quotes, as stored beside exported rows."""
    column = F.lit(text) if isinstance(text, str) else text
    return F.translate(column, " '\"", "")


def batches(rows: Iterable, size: int = BATCH_ROWS) -> Iterator[list]:
    iterator = iter(rows)
    while batch := list(islice(iterator, size)):
        yield batch


def export_counters(df: DataFrame, value_column: str) -> DataFrame:
    """One row: how many rows can be exported and how many lack a value.

    A plain aggregate is exact even when tasks are repeated, which an
    accumulator is not.
    """
    present = F.col(value_column).isNotNull()
    return df.agg(F.count_if(present).alias("success"), F.count_if(~present).alias("failed"))


def observed(df: DataFrame, value_column: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` whose next action counts its rows on the way: ``success``, and ``failed`` for those without a value.

    Without a value column every row is one that can be exported. Nothing is read twice; where a stage before a
    shuffle is repeated, rows seen again may count again, so rows are observed behind the last shuffle.
    """
    present = F.lit(True) if value_column is None else F.col(value_column).isNotNull()
    seen = Observation()
    return df.observe(seen, F.count_if(present).alias("success"), F.count_if(~present).alias("failed")), seen


def send_all(rows: DataFrame, send: Callable[[Iterable], Iterator[list]]) -> dict[str, int]:
    """Run ``send`` on the rows of every task and count what it yields, batch by batch, as :func:`observed` does.

    Only the counts of the attempt that Spark keeps are added up.
    """

    def counted(part: Iterable) -> Iterator[tuple[int, int]]:
        success = failed = 0
        for batch in send(part):
            missing = sum(r["value"] is None for r in batch)
            success, failed = success + len(batch) - missing, failed + missing
        yield success, failed

    totals = rows.rdd.mapPartitions(counted).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return dict(zip(("success", "failed"), totals, strict=True))


def check_key_and_value(schema: T.StructType, key: str, value: str | None = None) -> None:
    """A key has to be primitive; a nested value may hold primitives only."""
    if is_complex(schema[key].dataType):
        raise ValueError(f"key column {key} has to be primitive")
    if value is None:
        return
    data_type = schema[value].dataType
    members = (
        [f.dataType for f in data_type]
        if isinstance(data_type, T.StructType)
        else [data_type.keyType, data_type.valueType]
        if isinstance(data_type, T.MapType)
        else [data_type.elementType]
        if isinstance(data_type, T.ArrayType)
        else []
    )
    if any(is_complex(m) for m in members):
        raise ValueError(f"value column {value} may hold primitive members only")
