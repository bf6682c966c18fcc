"""Text statistics as column expressions, and labelled samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import WORD

BLANKS = " \t\n\x0b\x0c\r"
#: Labelled rows that a model is fitted to at most, those with the smallest hash of their id.
FIT_ROWS = 20_000


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), use)[0]


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return bound(lines, lambda some: F.size(some) - F.size(F.array_distinct(some))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside a window of three that the text has twice or more.

    Windows are compared by a 64-bit hash within one text: sorted, so that equal ones
    are neighbours, then put back in order of place to add up what they cover.
    """

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        pairs = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) >= 3, F.array_sort(pairs))

    def places(s: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), (j > 0) & (x["h"] == F.get(s, j - 1)["h"]), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    found = bound(words, lambda w: bound(windows(w), lambda s: bound(places(s), covered)))
    return F.coalesce(found, F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Every fifth id by CRC-32 of its text; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(statistics: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows that are not held out, as ``label`` and the statistics.

    Rows are chosen by a hash whose bound follows from their number, so each task sends
    only its share; the same input gives the same rows.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    joined = statistics.where(~F.col("held_out")).join(known, "doc_id")
    share = min(1.0, 0.95 * rows / max(1, joined.count()))
    hashed = F.pmod(F.xxhash64(*statistics.columns, "label"), F.lit(1 << 30))
    return joined.where(hashed < int(share * (1 << 30))).limit(rows)
