"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import packed, quoted, shared_table, unpacked


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 3
) -> DataFrame:
    """``docs`` without the lines that stand on more than ``ratio`` of a host's pages, with ``n_lines`` and ``n_dropped``.

    A page is a row; lines are split at ``\\n`` and compared as they are, by a 64-bit hash
    and the host. A line counts once per page and must stand on ``min_pages`` pages at
    least, so that small hosts are not emptied. Lines without a word are kept.
    Pages without a host and null texts are left alone; repeated rows are pages of their
    own; columns named like a result column are replaced; an empty table stays empty.

    Counts are reduced on the map side by host and line, so a host with a third of all
    pages costs no more than its distinct lines. A host has fewer than (lines of a page /
    ratio) such lines; they are stored as one small row per host and joined to the pages,
    by broadcast if that table is measured to be small and else by a join that splits
    hot hosts.
    """
    body = F.split(quoted(text), "\n")
    pages = docs.where(quoted(host).isNotNull()).select(quoted(host).alias("host"), quoted(text).alias("text"))
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _has_word), lambda line: F.xxhash64(line)))
    counts = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    frequent = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    listed = shared_table(frequent.groupBy("host").agg(F.collect_list("line").alias("boilerplate")), "boilerplate")
    rows = packed(docs, host=quoted(host)).join(listed, "host", "left")
    lines = F.split(F.col("row").getField(text), "\n")
    kept = F.when(
        F.col("boilerplate").isNotNull(),
        F.filter(lines, lambda line: ~(_has_word(line) & F.array_contains("boilerplate", F.xxhash64(line)))),
    ).otherwise(lines)
    cut = rows.select("row", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), kept.alias("kept"))
    known = F.col("row").getField(text).isNotNull()
    out = cut.select(
        "row",
        F.array_join("kept", "\n").alias(text),
        F.when(known, F.col("n_lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(known, F.col("n_lines") - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
    )
    return unpacked(out, docs.columns, [text, "n_lines", "n_dropped"])


def _has_word(line):
    return line.rlike(r"[^\x20\x09-\x0D]")


ORACLE = """
WITH pages AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL),
seen AS (SELECT source, line, count(DISTINCT doc_id) AS c FROM lines GROUP BY source, line),
boiler AS (
  SELECT s.source, list(s.line) AS found FROM seen s JOIN pages p ON p.source = s.source
  WHERE s.c >= 3 AND s.c > 0.1 * p.n AND trim(s.line) <> '' GROUP BY s.source
),
kept AS (
  SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines,
    CASE WHEN b.found IS NULL THEN string_split(d.text, chr(10))
      ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.found, x)) END AS lines
  FROM documents d LEFT JOIN boiler b ON b.source = d.source
)
SELECT doc_id, n_lines, n_lines - len(lines) AS n_dropped, sha256(array_to_string(lines, chr(10))) AS text_sha256 FROM kept
"""
