"""Normalising SQL text held in a column, so that only real changes alter its digest."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What does not count as part of a query.
COMMENT_START = "--"
BLANKS = " \t\r\x0b\x0c"
SETTING = r"(?i)( |^)SET [^;]++;"
PIECE = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^"'\\]++|\\.|["'\\])"""
BLANK_IN_QUOTES = ";"
BLANK_RUN = r" \s++|[\t\n\x0B\f\r]\s*+"
#: A comment up to the end of its line, and a line end with the blanks and empty lines around it.
COMMENT = rf"(?dm)^[{BLANKS}]*+{COMMENT_START}[^\n]*+"
LINE_END = rf"\n[{BLANKS}\n]*+"
BLANK_LINE_END = rf"(?<![{BLANKS}])[{BLANKS}]*+{LINE_END}"


def _holds(text: Column, *parts: str) -> Column:
    return reduce(or_, (text.contains(p) for p in parts))


def _joined(text: Column) -> Column:
    """The lines without comments and surrounding blanks, joined by one blank."""
    comments = text.contains(COMMENT_START)
    uncommented = F.when(comments, F.regexp_replace(text, COMMENT, "")).otherwise(text)
    lines = (
        F.when(comments | _holds(text, *(b + "\n" for b in BLANKS)), F.regexp_replace(uncommented, BLANK_LINE_END, " "))
        .when(_holds(text, *("\n" + b for b in BLANKS + "\n")), F.regexp_replace(text, LINE_END, " "))
        .otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    )
    edges = [F.substring(text, at, 1).isin(*BLANKS, "\n") for at in (1, -1)]
    return F.when(comments | edges[0] | edges[1], F.trim(lines, F.lit(BLANKS + "\n"))).otherwise(lines)


def _settled(text: Column) -> Column:
    return F.when(F.lower(text).contains("set "), F.regexp_replace(text, SETTING, "")).otherwise(text)


def _squeezed(text: Column) -> Column:
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(PIECE), F.lit(1)),
        lambda p: F.when(p.rlike("(?s)^[\"'].*[\"']$"), F.regexp_replace(p, r"\s", BLANK_IN_QUOTES)).otherwise(
            F.regexp_replace(p, BLANK_RUN, " ")
        ),
    )
    quoted, runs = _holds(text, '"', "'", "\\"), _holds(text, "  ", *BLANKS[1:])
    return F.trim(F.when(quoted, F.array_join(pieces, "")).when(runs, F.regexp_replace(text, BLANK_RUN, " ")).otherwise(text))


STEPS = (_joined, _settled, _squeezed)


def normalize_sql(text: Column) -> Column:
    """Drop comment lines and SET statements and squeeze blanks outside quotes.

    Blanks inside quotes count: each becomes one ``;``.
    """
    return reduce(lambda column, step: step(column), STEPS, text)


def with_normalized_sql(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the text of ``column`` normalised, step by step.

    Each step first looks for what it is about, on the result of the one before; as a
    projection of its own that result is made once, and most texts skip the patterns.
    """
    return reduce(lambda out, step: out.withColumn(column, step(F.col(column))), STEPS, df)
