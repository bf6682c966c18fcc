"""Partition state and staleness over partitions derived from customers, suppliers and orders.

Four views build on each other: one partition per customer, per nation, per
region, and one in total. A customer's partition time is its newest order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from viewforge_queries.common import table
from viewforge.functions.digests import digest
from viewforge.functions.dates import month_text, year_text
from viewforge.model import Field, ViewDef
from viewforge.operators import state as st
from viewforge.operators import state_log
from viewforge.operators.partitions import select_partitions
from viewforge.plans.refresh import partition_text, refresh_partitions
from viewforge.session import scratch_path
from viewforge.sources.formats import read_view, write_view

NOW = 1_000_000


def _customers(spark, sf_dir):
    """``c_custkey, c_nationkey, ts``; customers without orders never ran."""
    newest = (
        table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("ts"))
    )
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_acctbal")
        .join(newest, "c_custkey", "left")
        .withColumn("ts", F.coalesce("ts", F.lit(0)))
    )


def _upper(spark, sf_dir):
    """Partitions of the nation, region and total views; every fifth nation ran last."""
    nations = table(spark, sf_dir, "nation")
    nation_rows = nations.select(
        F.lit("by_nation").alias("view"),
        F.col("n_nationkey").cast("string").alias("partition"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit(NOW - 1)).otherwise(F.col("n_nationkey") * 10).cast("long").alias("ts"),
        (F.col("n_nationkey") == 10).alias("materialize_once"),
    )
    region_rows = table(spark, sf_dir, "region").select(
        F.lit("by_region").alias("view"),
        F.col("r_regionkey").cast("string").alias("partition"),
        F.lit(NOW - 1).cast("long").alias("ts"),
        F.lit(False).alias("materialize_once"),
    )
    total = region_rows.groupBy().agg(F.max("ts").alias("ts")).select(
        F.lit("total").alias("view"), F.lit("all").alias("partition"), "ts", F.lit(True).alias("materialize_once")
    )
    return nation_rows.unionByName(region_rows).unionByName(total)


def state_rows(spark, sf_dir):
    """Every tenth customer was computed with another query."""
    customers = _customers(spark, sf_dir).select(
        F.lit("by_customer").alias("view"),
        F.col("c_custkey").cast("string").alias("partition"),
        F.col("ts"),
        F.lit(False).alias("materialize_once"),
        F.when(F.col("c_custkey") % 10 == 3, "old").otherwise("q1").alias("checksum"),
        (F.col("c_custkey") % 7 != 1).alias("has_data"),
        (F.col("c_custkey") % 30 == 23).alias("failed"),
    )
    upper = _upper(spark, sf_dir).withColumns(
        {"checksum": F.lit("q1"), "has_data": F.lit(True), "failed": F.lit(False)}
    )
    return customers.unionByName(upper)


def dep_rows(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer")

    def edges(df, view, partition, dep_view, dep):
        return df.select(
            F.lit(view).alias("view"),
            F.col(partition).cast("string").alias("partition") if partition else F.lit("all").alias("partition"),
            F.lit(dep_view).alias("dep_view"),
            F.col(dep).cast("string").alias("dep_partition"),
        )

    return (
        edges(customers, "by_nation", "c_nationkey", "by_customer", "c_custkey")
        .unionByName(edges(nations, "by_region", "n_regionkey", "by_nation", "n_nationkey"))
        .unionByName(edges(table(spark, sf_dir, "region"), "total", None, "by_region", "r_regionkey"))
    )


def current_rows(spark, sf_dir):
    """The checksum each view has now: one row per view."""
    return state_rows(spark, sf_dir).select("view").distinct().withColumn("checksum", F.lit("q1"))


def _run(mode):
    def query(spark, sf_dir):
        result = st.materialization(
            state_rows(spark, sf_dir), dep_rows(spark, sf_dir), current_rows(spark, sf_dir), NOW, mode
        )
        return result.select("view", "partition", "status", "recompute", "new_checksum", "new_ts")

    return query


def stale(spark, sf_dir):
    return st.stale_partitions(state_rows(spark, sf_dir), dep_rows(spark, sf_dir), current_rows(spark, sf_dir), NOW)


def materialize_once(spark, sf_dir):
    result = st.materialization(
        state_rows(spark, sf_dir), dep_rows(spark, sf_dir), current_rows(spark, sf_dir), NOW
    )
    once = state_rows(spark, sf_dir).where("materialize_once").select("view", "partition")
    return result.join(once, ["view", "partition"], "left_semi").select("view", "partition", "recompute", "new_ts")


def flags(spark, sf_dir):
    return st.propagate_flags(state_rows(spark, sf_dir), dep_rows(spark, sf_dir), current_rows(spark, sf_dir), NOW)


def metadata(spark, sf_dir):
    """The state of partitions with the current checksum is known; the others get defaults."""
    state = state_rows(spark, sf_dir).where("checksum = 'q1'")
    return st.partition_metadata(state, state_rows(spark, sf_dir).select("view", "partition"))


def invalidate(spark, sf_dir):
    rows = state_rows(spark, sf_dir)
    return st.invalidate(rows, rows.where("NOT has_data OR materialize_once").select("view", "partition"))


def commit(spark, sf_dir):
    rows = state_rows(spark, sf_dir)
    updates = rows.where("checksum = 'old'").select("view", "partition", F.lit("q1").alias("checksum"))
    return st.commit_state(rows, updates, NOW)


def schema_changes(spark, sf_dir):
    """One table per customer.

    Customers in debt had no table before, those of one nation a table without a
    checksum. Those of one segment have no table any more, those of another
    segment a new declaration.
    """
    customers = table(spark, sf_dir, "customer").withColumn("table_name", F.concat(F.lit("t_"), F.col("c_custkey")))
    segment = F.col("c_mktsegment")
    text = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" "), segment)
    old = customers.where(F.col("c_acctbal") >= 0).select(
        "table_name", F.when(F.col("c_nationkey") != 3, digest(F.array(text))).alias("checksum")
    )
    changed = F.when(segment == "BUILDING", F.concat(text, F.lit(" v2"))).otherwise(text)
    new = customers.where(segment != "MACHINERY").select("table_name", digest(F.array(changed)).alias("checksum"))
    return st.schema_changes(old, new)


def transformation_changes(spark, sf_dir):
    """Every document is the query of a view; half the stored checksums are those of the same text in another layout."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("v_"), F.col("doc_id")).alias("view"), "doc_id", "text"
    )
    now = documents.select(
        "view", F.concat(F.lit("SET a=b;\n-- note\n"), F.regexp_replace("text", "\n", "\n\n  ")).alias("sql")
    )
    stored_text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" LIMIT 1")))
    stored = st.transformation_checksums(documents.select("view", stored_text.alias("sql"))).select(
        "view", F.lit("all").alias("partition"), "checksum"
    )
    return st.transformation_changes(stored, now)


def state_table(spark, sf_dir):
    """Every partition's state in commits of falling and equal size, some of them late, read after merges."""
    path, rows = scratch_path(spark, "state"), state_rows(spark, sf_dir)
    key = F.length(F.concat("view", "partition"))
    state_log.commit(rows, path, 1)
    for part in range(4):
        newer = rows.where(key % 5 == part).withColumns({"checksum": F.lit(f"c{part}"), "ts": F.col("ts") + 1})
        state_log.commit(newer, path, 10 - part)
        state_log.commit(rows.where(key % 10 == part).withColumn("checksum", F.lit("late")), path, 2)
    return state_log.read(spark, path)


MONTHLY_ORDERS = ViewDef(
    "MonthlyOrders",
    [Field("id", "bigint"), Field("price", "double")],
    package="checks.state",
    partitions=[Field("year", "string"), Field("month", "int"), Field("status", "string")],
)


def refresh(spark, sf_dir):
    """A monthly table of which the even months are out of date; they are rebuilt with new prices.

    Each month depends on a raw month that changed at time 5 or 1; the table was
    last computed at time 3. Months are numbers that the state writes with two digits;
    the status is null or holds characters that folder names escape.
    """
    at = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), year_text(at).alias("year"), F.month(at).alias("month"),
        F.when(F.col("o_orderstatus") == "F", "F/1 %").when(F.col("o_orderstatus") == "P", "p q").alias("status"),
    )
    path, log = scratch_path(spark, "refresh"), scratch_path(spark, "refresh_state")
    write_view(rows, MONTHLY_ORDERS, path)
    name = MONTHLY_ORDERS.table_name()
    digits = rows.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    months = digits.select(partition_text(["year", "month", "status"]).alias("partition"), "month").distinct()
    known = months.select(F.lit(name).alias("view"), "partition", F.lit("q").alias("checksum"), F.lit(3).cast("long").alias("ts"))
    st.append_state(known, log, 1)
    raw_ts = F.when(F.col("month").cast("int") % 2 == 0, 5).otherwise(1).cast("long")
    raw = months.select(F.lit("raw").alias("view"), "partition", F.lit("q").alias("checksum"), raw_ts.alias("ts"))
    deps = months.select(
        F.lit(name).alias("view"), "partition", F.lit("raw").alias("dep_view"), F.col("partition").alias("dep_partition")
    )
    current = raw.select("view", "checksum").distinct().unionByName(known.select("view", "checksum").distinct())
    stale_rows = st.stale_partitions(st.read_state(spark, log).unionByName(raw), deps, current, 9)
    refresh_partitions(
        MONTHLY_ORDERS,
        lambda wanted: select_partitions(rows.withColumn("price", F.col("price") + 1), wanted),
        stale_rows, path, log, "q", 9,
    )
    times = st.read_state(spark, log).select(
        F.regexp_extract("partition", r"year=(\d+)", 1).alias("year"),
        F.regexp_extract("partition", r"month=(\d+)", 1).cast("int").alias("month"),
        "ts",
    ).distinct()
    return read_view(spark, MONTHLY_ORDERS, path).join(times, ["year", "month"])


QUERIES = {
    "refresh_partitions": refresh,
    "stale_partitions": stale,
    "materialization_default": _run("default"),
    "stale_mode_reset_checksums": _run("reset_checksums"),
    "stale_mode_dry_run": _run("reset_checksums_and_timestamps"),
    "stale_mode_transform_only": _run("transform_only"),
    "stale_mode_set_only": _run("set_only"),
    "materialize_once": materialize_once,
    "propagate_flags": flags,
    "partition_metadata": metadata,
    "invalidate_partitions": invalidate,
    "commit_state": commit,
    "state_table": state_table,
    "schema_changes": schema_changes,
    "transformation_changes": transformation_changes,
}

# Texts without comment lines, settings and needless blanks, and their digests.
TRANSFORMATIONS_SQL = r"""
WITH texts AS (
  SELECT doc_id, 'SET a=b;' || chr(10) || '-- note' || chr(10) || replace(text, chr(10), chr(10) || chr(10) || '  ') AS now,
         CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' LIMIT 1' END AS before
  FROM documents),
both_texts AS (SELECT doc_id, 'now' AS kind, now AS t FROM texts UNION ALL SELECT doc_id, 'before', before FROM texts),
joined AS (
  SELECT doc_id, kind, array_to_string(list_filter(list_transform(string_split(t, chr(10)),
         lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '' AND NOT starts_with(x, '--')), ' ') AS t
  FROM both_texts),
pieces AS (
  SELECT doc_id, kind, regexp_extract_all(regexp_replace(t, '(?i)( |^)SET [^;]+;', '', 'g'),
         '(?s)"[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|[^"''\\]+|\\.|["''\\]') AS p
  FROM joined),
digests AS (
  SELECT doc_id, kind, upper(md5(trim(array_to_string(list_transform(p, lambda x:
         CASE WHEN length(x) > 1 AND (starts_with(x, chr(34)) AND ends_with(x, chr(34)) OR starts_with(x, chr(39)) AND ends_with(x, chr(39)))
              THEN regexp_replace(x, '[ \t\n\x0B\f\r]', ';', 'g')
              ELSE regexp_replace(x, '[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]', ' ', 'g') END), ''), ' '))) AS d
  FROM pieces)
SELECT 'v_' || doc_id AS view, 'all' AS partition, b.d AS checksum, n.d AS new_checksum
FROM digests b JOIN digests n USING (doc_id) WHERE b.kind = 'before' AND n.kind = 'now' AND b.d IS DISTINCT FROM n.d
"""

# The same four levels, written out one after the other.
STATE_SQL = f"""
state AS (
  SELECT 'by_customer' AS view, CAST(c_custkey AS VARCHAR) AS partition, COALESCE(m, 0) AS ts, false AS once,
         CASE WHEN c_custkey % 10 = 3 THEN 'old' ELSE 'q1' END AS checksum, c_custkey % 7 <> 1 AS has_data,
         c_custkey % 30 = 23 AS failed, CAST(c_nationkey AS VARCHAR) AS parent
  FROM customer LEFT JOIN (SELECT o_custkey, MAX(o_orderkey) AS m FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  UNION ALL
  SELECT 'by_nation', CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 5 = 0 THEN {NOW - 1} ELSE n_nationkey * 10 END,
         n_nationkey = 10, 'q1', true, false, CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL
  SELECT 'by_region', CAST(r_regionkey AS VARCHAR), {NOW - 1}, false, 'q1', true, false, 'all' FROM region
  UNION ALL
  SELECT 'total', 'all', {NOW - 1}, true, 'q1', true, false, NULL
)"""


def _levels(use_checksum: bool, dry: bool, writes_checksum: bool) -> str:
    """Outcome per level from the outcomes of the level below."""

    def outcome(source: str) -> str:
        stale = "ts < freshness" + (" OR checksum <> 'q1'" if use_checksum else "")
        due = f"(NOT (once AND ts > 0) AND any_data AND ({stale}))"
        recompute = "false" if dry else due
        status = (
            f"CASE WHEN NOT (once AND ts > 0) AND NOT any_data THEN 'no_data' WHEN {recompute} AND failed THEN 'failed' "
            f"WHEN {recompute} AND NOT has_data THEN 'no_data' ELSE 'materialized' END"
        )
        takes = "status = 'materialized'" + ("" if writes_checksum else " AND due")
        return (
            f"SELECT view, partition, parent, status, recompute, "
            f"CASE WHEN {takes} THEN 'q1' ELSE checksum END AS new_checksum, "
            f"CASE WHEN status = 'materialized' AND due THEN {NOW} ELSE ts END AS new_ts, "
            f"status = 'materialized' AND dep_errors AS with_errors, status = 'materialized' AND dep_incomplete AS incomplete "
            f"FROM (SELECT *, {due} AS due, {recompute} AS recompute, {status} AS status FROM {source}) x"
        )

    def above(view: str, below: str) -> str:
        return (
            f"(SELECT s.*, CASE WHEN s.once AND s.ts > 0 THEN 1 ELSE COALESCE(f, 0) END AS freshness, "
            f"(s.once AND s.ts > 0) OR COALESCE(d, false) AS any_data, "
            f"NOT (s.once AND s.ts > 0) AND COALESCE(i, false) AS dep_incomplete, "
            f"NOT (s.once AND s.ts > 0) AND COALESCE(e, false) AS dep_errors "
            f"FROM state s LEFT JOIN (SELECT parent AS p, MAX(new_ts) FILTER (status = 'materialized') AS f, "
            f"bool_or(status = 'materialized') AS d, bool_or(status <> 'materialized' OR incomplete) AS i, "
            f"bool_or(status = 'failed' OR with_errors) AS e FROM {below} GROUP BY parent) r ON r.p = s.partition "
            f"WHERE s.view = '{view}') a"
        )

    leaf = "(SELECT *, 1 AS freshness, true AS any_data, false AS dep_incomplete, false AS dep_errors FROM state WHERE view = 'by_customer') a"
    return (
        f"WITH {STATE_SQL}, c AS ({outcome(leaf)}), n AS ({outcome(above('by_nation', 'c'))}), "
        f"r AS ({outcome(above('by_region', 'n'))}), t AS ({outcome(above('total', 'r'))}), "
        "outcome AS (SELECT * FROM c UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r UNION ALL SELECT * FROM t) "
    )


RESULT = "SELECT view, partition, status, recompute, new_checksum, CAST(new_ts AS BIGINT) AS new_ts FROM outcome"
DEFAULT = _levels(use_checksum=True, dry=False, writes_checksum=False)

ORACLE = {
    "refresh_partitions": "SELECT o_orderkey AS id, CASE WHEN even THEN o_totalprice + 1 ELSE o_totalprice END AS price, "
    "strftime(o_orderdate, '%Y') AS year, CAST(MONTH(o_orderdate) AS INTEGER) AS month, "
    "CASE o_orderstatus WHEN 'F' THEN 'F/1 %' WHEN 'P' THEN 'p q' END AS status, CAST(CASE WHEN even THEN 9 ELSE 3 END AS BIGINT) AS ts "
    "FROM (SELECT *, MONTH(o_orderdate) % 2 = 0 AS even FROM orders) o",
    "stale_partitions": DEFAULT + "SELECT view, partition FROM outcome WHERE recompute",
    "materialization_default": DEFAULT + RESULT,
    "stale_mode_reset_checksums": _levels(use_checksum=False, dry=False, writes_checksum=True) + RESULT,
    "stale_mode_dry_run": _levels(use_checksum=True, dry=True, writes_checksum=False) + RESULT,
    "stale_mode_transform_only": f"WITH {STATE_SQL}, due AS (SELECT *, NOT (once AND ts > 0) AND (ts < 1 OR checksum <> 'q1') AS due "
    "FROM state), s AS (SELECT *, CASE WHEN due AND failed THEN 'failed' WHEN due AND NOT has_data THEN 'no_data' "
    "ELSE 'materialized' END AS status FROM due) SELECT view, partition, status, due AS recompute, "
    f"CASE WHEN due AND status = 'materialized' THEN 'q1' ELSE checksum END AS new_checksum, "
    f"CAST(CASE WHEN due AND status = 'materialized' THEN {NOW} ELSE ts END AS BIGINT) AS new_ts FROM s",
    "stale_mode_set_only": f"WITH {STATE_SQL} SELECT view, partition, 'materialized' AS status, false AS recompute, "
    f"'q1' AS new_checksum, CAST({NOW} AS BIGINT) AS new_ts FROM state",
    "materialize_once": DEFAULT + "SELECT view, partition, recompute, CAST(new_ts AS BIGINT) AS new_ts FROM outcome "
    "WHERE view = 'total' OR (view = 'by_nation' AND partition = '10')",
    "propagate_flags": DEFAULT + "SELECT view, partition, status, status = 'no_data' AS no_data, incomplete, with_errors FROM outcome",
    "partition_metadata": f"WITH {STATE_SQL} SELECT view, partition, CASE WHEN checksum = 'q1' THEN checksum ELSE '0' END AS checksum, "
    "CAST(CASE WHEN checksum = 'q1' THEN ts ELSE 0 END AS BIGINT) AS ts FROM state",
    "invalidate_partitions": f"WITH {STATE_SQL} SELECT view, partition, CASE WHEN NOT has_data OR once THEN '0' ELSE checksum END AS checksum, "
    "CAST(CASE WHEN NOT has_data OR once THEN 0 ELSE ts END AS BIGINT) AS ts FROM state",
    "state_table": f"WITH {STATE_SQL}, keyed AS (SELECT *, length(view || partition) AS n FROM state) SELECT view, partition, "
    "CASE WHEN n % 5 < 4 THEN 'c' || n % 5 WHEN n % 10 < 4 THEN 'late' ELSE checksum END AS checksum, "
    "CAST(CASE WHEN n % 5 < 4 THEN ts + 1 ELSE ts END AS BIGINT) AS ts FROM keyed",
    "commit_state": f"WITH {STATE_SQL} SELECT view, partition, 'q1' AS checksum, "
    f"CAST(CASE WHEN checksum = 'old' THEN {NOW} ELSE ts END AS BIGINT) AS ts FROM state",
    "schema_changes": "SELECT 't_' || c_custkey AS table_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'dropped' "
    "WHEN c_acctbal < 0 OR c_nationkey = 3 OR c_mktsegment = 'BUILDING' THEN 'recreate' ELSE 'keep' END AS change "
    "FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_acctbal >= 0",
    "transformation_changes": TRANSFORMATIONS_SQL,
}
