"""Expanding partition patterns into the partitions they name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from math import prod
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.functions.dates import EARLIEST_DAY, day_range, month_range
from viewforge.operators.joins import SPREAD, group_for_join

# The notation of one parameter.
MONTH = r"(\d{4})(0[1-9]|10|11|12)"
DAY = MONTH + r"(0[1-9]|[12][0-9]|30|31)"
NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
TYPED_VALUES = {
    "t": (r"(true|false)", "boolean"),
    "i": (r"(\d+)", "int"),
    "l": (r"(\d+)", "bigint"),
    "b": (r"(\d+)", "tinyint"),
    "f": (NUMBER, "float"),
    "d": (NUMBER, "double"),
}
ENUMERATION = r"(e|et|ei|el|eb|ef|ed|eym|eymd|erym|erymd)\s*\((.*)\)"
ESCAPED = {"\\(": "(", "\\)": ")", "\\\\": "\\", "\\,": ",", "\\-": "-"}


def _call(name: str, body: str) -> str:
    return rf"{name}\s*\(\s*{body}\s*\)"


def _unescape(text: str) -> str:
    return re.sub(r"\\[()\\,\-]", lambda m: ESCAPED[m.group(0)], text)


def _struct(*columns: Column) -> Column:
    return F.struct(*(c.alias(f"v{i}") for i, c in enumerate(columns)))


def _date_struct(day: Column, with_day: bool) -> Column:
    patterns = ["yyyy", "MM", "dd"] if with_day else ["yyyy", "MM"]
    return _struct(*(F.date_format(day, p) for p in patterns))


def _choices(parameter: str, earliest: str) -> tuple[Column, int]:
    """The array of values one parameter stands for, and how many columns each value fills."""
    text = parameter.strip()
    if m := re.fullmatch(ENUMERATION, text, re.S):
        kind, body = m.group(1)[1:], m.group(2)
        values = re.split(r"(?<!\\),", body)
        parts = [_choices(f"{kind}({v})" if kind else v, earliest) for v in values]
        widths = {width for _, width in parts}
        if len(widths) != 1:
            raise ValueError(f"values of different widths in {parameter!r}")
        return F.concat(*(choice for choice, _ in parts)), widths.pop()
    for name, pattern, width in (("rymd", DAY, 3), ("rym", MONTH, 2)):
        if m := re.fullmatch(_call(name, rf"{pattern}\s*[-]\s*{pattern}"), text):
            bounds = sorted(["-".join(m.groups()[:width]), "-".join(m.groups()[width:])])
            low, high = (b if width == 3 else f"{b}-01" for b in bounds)
            days = day_range(low, high, earliest) if width == 3 else month_range(low, high, earliest)
            return F.transform(days, lambda d: _date_struct(d, width == 3)), width
    for name, pattern, width in (("ymd", DAY, 3), ("ym", MONTH, 2)):
        if m := re.fullmatch(_call(name, pattern), text):
            return F.array(_struct(*(F.lit(g) for g in m.groups()))), width
    if re.fullmatch(r"null\s*\(\s*\)", text):
        return F.array(_struct(F.lit(None).cast("string"))), 1
    for name, (pattern, spark_type) in TYPED_VALUES.items():
        if m := re.fullmatch(_call(name, pattern), text):
            return F.array(_struct(F.lit(m.group(1)).cast(spark_type))), 1
    return F.array(_struct(F.lit(_unescape(parameter)))), 1


def expand_partitions(
    spark: SparkSession,
    parameters: Sequence[str],
    names: Sequence[str],
    earliest: str = EARLIEST_DAY,
) -> DataFrame:
    """One row per partition that the parameter patterns name.

    Each pattern becomes a constant array. The combinations are numbered, and the digits of a number, one per
    pattern and with the size of its array as base, say which values it stands for; so many tasks build the product
    from a range. ``names`` are the result columns; ``ym`` patterns fill two of them and ``ymd`` patterns three.
    """
    left, own, taken = list(names), [], []
    for parameter in parameters:
        choices, width = _choices(parameter, earliest)
        if len(left) < width:
            raise ValueError(f"not enough column names for {parameter!r}")
        own, taken, left = [*own, choices], [*taken, left[:width]], left[width:]
    if left:
        raise ValueError(f"no parameter for columns {left}")
    if not own:
        return spark.range(1).select()
    # One row: what each pattern stands for, evaluated once and sent back as a constant.
    arrays = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(own)))
    constants = arrays.select(*(F.struct(F.size(c).alias("n"), F.to_json(c).alias("json")) for c in arrays.columns)).first()
    total = prod(c["n"] for c in constants)
    if total >= 1 << 63:
        raise ValueError(f"{total} partitions are more than can be numbered")
    columns, below = [], total
    for names_, field, constant in zip(taken, arrays.schema, constants, strict=True):
        if total:
            below //= constant["n"]
        digit = F.expr(f"id div {max(1, below)}")
        value = F.get(F.from_json(F.lit(constant["json"]), field.dataType), (digit % max(1, constant["n"])).cast("int"))
        columns += [value.getField(f"v{i}").alias(n) for i, n in enumerate(names_)]
    return spark.range(total).select(*columns)


def select_partitions(data: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``data`` in the wanted partitions (null-safe on the shared columns).

    Only a join on plain equality lets Spark skip the folders that are not wanted,
    so the null-safe comparison is kept for wanted partitions that hold a null.
    Spark prunes by the other side of a join when that is small and filtered; the
    comparison with the empty text is true for every value and serves as the filter.
    """
    names = wanted.columns
    missing = reduce(or_, (F.col(n).isNull() for n in names))
    with_nulls = any(f.nullable for f in wanted.schema) and not wanted.where(missing).isEmpty()
    rows = wanted if with_nulls else wanted.where(reduce(and_, (F.col(n).cast("string") >= "" for n in names)))
    renamed = rows.select(*(F.col(n).alias(f"_w_{n}") for n in names))
    renamed = group_for_join(renamed, renamed.columns).agg(F.lit(True).alias("_wanted")).drop(SPREAD, "_wanted")

    def same(n: str) -> Column:
        left, right = data[n], renamed[f"_w_{n}"]
        return left.eqNullSafe(right) if with_nulls else left == right

    return data.join(renamed, reduce(and_, (same(n) for n in names)), "left_semi")
