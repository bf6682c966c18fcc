"""Running SQL text as a view transformation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# How a semicolon inside a statement is written.
ESCAPED_SEMICOLON = "\\;"


def substitute(text: str, params: Mapping[str, object]) -> str:
    """Replace ``${name}`` with quoted and ``§{name}`` with raw values.

    Both forms escape semicolons; the quoted form also escapes quotes and turns
    ``$`` into ``|``. Prefer bound arguments (``args`` of :func:`sql_transform`)
    for values.
    """

    def value_of(match: re.Match[str]) -> str:
        sign, name = match.group(1), match.group(2)
        if name not in params:
            return match.group(0)
        value = params[name]
        text = str(value).lower() if isinstance(value, bool) else str(value)
        if sign == "§":
            return text.replace(";", ESCAPED_SEMICOLON)
        return re.sub(r"[;\"']", lambda m: "\\" + m.group(0), text.replace("$", "|"))

    return re.sub(r"([$§])\{([^}]+)\}", value_of, text)


def split_statements(text: str) -> list[str]:
    r"""Statements between semicolons; ``\;`` stands for a semicolon inside one."""
    parts = re.split(r"(?<!\\);", text)
    return [p.replace(ESCAPED_SEMICOLON, ";").strip() for p in parts if p.strip()]


@contextmanager
def scoped_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold only inside the block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def register_functions(spark: SparkSession, functions: Mapping[str, object]) -> list[str]:
    """Register named functions that do not exist yet; returns the new names.

    A text is the class name of a JVM function, anything else a Python function
    or a (vectorised) user defined function.
    """
    added = []
    for name, function in functions.items():
        if spark.catalog.functionExists(name):
            continue
        if isinstance(function, str):
            spark.udf.registerJavaFunction(name, function)
        else:
            spark.udf.register(name, function)
        added.append(name)
    return added


SETTING = re.compile(r"SET\s+([^=\s]+)\s*=\s*(.*)", re.I | re.S)


def sql_transform(
    spark: SparkSession,
    text: str,
    params: Mapping[str, object] | None = None,
    args: Mapping[str, object] | None = None,
    settings: Mapping[str, str] | None = None,
    functions: Mapping[str, object] | None = None,
    write: Callable[[DataFrame], T] | None = None,
) -> DataFrame | T:
    """Run the statements in order and hand the frame of the last one to ``write``.

    ``params`` are replaced in the text, ``args`` are bound as named parameters.
    ``SET k=v`` statements and ``settings`` hold while the statements run and
    while the result is written; without ``write`` the frame is returned, and a
    setting that steers execution no longer holds when the caller runs it. The
    first statement that fails stops the rest.
    """
    register_functions(spark, functions or {})
    statements = split_statements(substitute(text, params or {}))
    scoped = dict(settings or {})
    queries = []
    for statement in statements:
        if m := SETTING.fullmatch(statement):
            scoped[m.group(1)] = m.group(2).strip()
        else:
            queries.append(statement)
    if not queries:
        raise ValueError("no statement to run")
    with scoped_settings(spark, scoped):
        for query in queries:
            frame = spark.sql(query, args=_used_args(query, args or {}))
        return frame if write is None else write(frame)


def _used_args(query: str, args: Mapping[str, object]) -> dict[str, object]:
    return {k: v for k, v in args.items() if re.search(rf":{re.escape(k)}\b", query)}


def row_mapper(
    rows: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """A user's map function over batches of records; no shuffle, nothing kept between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)


def run_then_export(
    df: DataFrame,
    write: Callable[[DataFrame], DataFrame],
    exports: Sequence[Callable[[DataFrame], object]],
    muted: bool = False,
) -> tuple[DataFrame, list[Exception]]:
    """Store the result once, then hand the stored rows to every export.

    A failing export does not fail the view: its error is returned. Exports read
    the stored table, so the transformation is not computed again.
    """
    stored = write(df)
    errors: list[Exception] = []
    for export in () if muted else exports:
        try:
            export(stored)
        except Exception as problem:  # noqa: BLE001 - reported to the caller
            errors.append(problem)
    return stored, errors
