"""Date ranges and partition expansion.

Ranges are taken per distinct order date; each expanded range is reduced to its
length and ends, so the result is checked without keeping every day of every range.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from viewforge_queries.common import table
from viewforge.functions import dates
from viewforge.functions.dates import month_text, year_text
from viewforge.operators.partitions import expand_partitions, select_partitions

EARLIEST = "1996-02-10"
LATEST = "2001-08-01"


def _days(spark, sf_dir):
    """Order dates with the number of orders."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _range(build):
    def query(spark, sf_dir):
        ranged = _days(spark, sf_dir).withColumn("r", build(F.col("day")))
        return ranged.select(
            F.col("day").cast("string").alias("day"),
            "n",
            F.size("r").alias("length"),
            F.get("r", 0).cast("string").alias("newest"),
            F.try_element_at("r", F.lit(-1)).cast("string").alias("oldest"),
        )

    return query


def _exploded(build):
    """How many orders lie in the ranges of each expanded day."""

    def query(spark, sf_dir):
        rows = _days(spark, sf_dir).select("n", F.explode(build(F.col("day"))).alias("d"))
        return rows.groupBy(F.col("d").cast("string").alias("d")).agg(F.sum("n").alias("n_orders"))

    return query


def _prev(function):
    def query(spark, sf_dir):
        orders = table(spark, sf_dir, "orders")
        return orders.select("o_orderkey", function(F.col("o_orderdate"), EARLIEST).cast("string").alias("before"))

    return query


def _per_month(build):
    def query(spark, sf_dir):
        months = _days(spark, sf_dir).groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("n").alias("n"))
        rows = months.select("n", "month", F.explode(build(F.col("month"))).alias("d"))
        return rows.withColumns({"month": F.col("month").cast("string"), "d": F.col("d").cast("string")})

    return query


def expand_query(spark, sf_dir):
    """Orders per partition, kept for the partitions a pattern names."""
    at = F.col("o_orderdate")
    partitions = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("status"), year_text(at).alias("year"), month_text(at).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wanted = expand_partitions(
        spark, ["e(O,F)", "erym(199906-199811,200101-200103)"], ["status", "year", "month"], earliest="1995-01-01"
    )
    return select_partitions(partitions, wanted)


QUERIES = {
    "prev_day": _prev(dates.prev_day),
    "prev_month": _prev(dates.prev_month),
    "day_range": _exploded(lambda d: dates.day_range(F.date_sub(d, 20), d, EARLIEST)),
    "month_range": _range(lambda d: dates.month_range(d, LATEST, EARLIEST)),
    "this_and_prev_days": _range(lambda d: dates.this_and_prev_days(d, EARLIEST)),
    "this_and_prev_days_of_month": _range(lambda d: dates.this_and_prev_days_of_month(d, EARLIEST)),
    "this_and_prev_months": _exploded(lambda d: dates.this_and_prev_months(d, EARLIEST)),
    "all_days": _range(lambda d: dates.all_days(LATEST, d)),
    "all_months": _range(lambda d: dates.all_months(LATEST, d)),
    "all_days_of_month": _per_month(dates.all_days_of_month),
    "last_days": _exploded(lambda d: dates.last_days(d, -7, EARLIEST)),
    "last_months": _exploded(lambda d: dates.last_months(d, -2, EARLIEST)),
    "expand_partitions": expand_query,
}

DAYS = "(SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1)"
E = f"DATE '{EARLIEST}'"


def _range_sql(low: str, high: str, step: str) -> str:
    return (
        "SELECT CAST(day AS VARCHAR) AS day, n, CAST(LEN(r) AS INT) AS length, CAST(CAST(r[LEN(r)] AS DATE) AS VARCHAR) AS newest, "
        "CAST(CAST(r[1] AS DATE) AS VARCHAR) AS oldest "
        f"FROM (SELECT day, n, generate_series(CAST({low} AS TIMESTAMP), CAST({high} AS TIMESTAMP), INTERVAL 1 {step}) AS r "
        f"FROM {DAYS} d) x"
    )


def _exploded_sql(low: str, high: str, step: str) -> str:
    return (
        "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS d, CAST(SUM(n) AS BIGINT) AS n_orders FROM (SELECT n, "
        f"UNNEST(generate_series(CAST({low} AS TIMESTAMP), CAST({high} AS TIMESTAMP), INTERVAL 1 {step})) AS d "
        f"FROM {DAYS} x) y GROUP BY 1"
    )


ORACLE = {
    "prev_day": f"SELECT o_orderkey, CAST(CASE WHEN o_orderdate > {E} THEN CAST(o_orderdate AS DATE) - 1 END AS VARCHAR) AS before FROM orders",
    "prev_month": f"SELECT o_orderkey, CAST(CASE WHEN date_trunc('month', o_orderdate) > {E} THEN "
    "CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) END AS VARCHAR) AS before FROM orders",
    "day_range": _exploded_sql(f"GREATEST(day - 20, {E})", "day", "DAY"),
    "month_range": _range_sql(f"date_trunc('month', GREATEST(day, {E}))", f"date_trunc('month', DATE '{LATEST}')", "MONTH"),
    "this_and_prev_days": _range_sql(E, "day", "DAY"),
    "this_and_prev_days_of_month": _range_sql(E, "last_day(day)", "DAY"),
    "this_and_prev_months": _exploded_sql(f"date_trunc('month', {E})", "date_trunc('month', day)", "MONTH"),
    "all_days": _range_sql("day", f"DATE '{LATEST}'", "DAY"),
    "all_months": _range_sql("date_trunc('month', day)", f"date_trunc('month', DATE '{LATEST}')", "MONTH"),
    "all_days_of_month": "SELECT CAST(n AS BIGINT) AS n, CAST(month AS VARCHAR) AS month, CAST(CAST(UNNEST(generate_series(CAST(month AS TIMESTAMP), "
    "CAST(last_day(month) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS d FROM "
    f"(SELECT CAST(date_trunc('month', day) AS DATE) AS month, SUM(n) AS n FROM {DAYS} d GROUP BY 1) m",
    "last_days": _exploded_sql(f"GREATEST(day - 7, {E})", "day", "DAY"),
    "last_months": _exploded_sql(
        f"date_trunc('month', GREATEST(date_trunc('month', day) - INTERVAL 2 MONTH, {E}))",
        f"CASE WHEN day >= {E} THEN date_trunc('month', day) ELSE DATE '1900-01-01' END",
        "MONTH",
    ),
    "expand_partitions": "SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y') AS year, "
    "strftime(o_orderdate, '%m') AS month, COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') AND "
    "(strftime(o_orderdate, '%Y%m') BETWEEN '199811' AND '199906' OR "
    "strftime(o_orderdate, '%Y%m') BETWEEN '200101' AND '200103') GROUP BY 1, 2, 3",
}
