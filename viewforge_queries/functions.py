"""Scalar functions and SQL transformations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge_queries.common import run_sql, table, with_views
from viewforge.operators.views import insert_into
from viewforge.functions.sqltext import normalize_sql
from viewforge.plans.transform import register_functions, row_mapper, run_then_export, sql_transform, substitute
from viewforge.model import Field, ViewDef
from viewforge.session import scratch_path
from viewforge.sources.formats import read_view, write_view

FUNCTIONS: dict[str, tuple] = {
    "f_string": (
        ["part"],
        "SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS sub, TRIM(BOTH 's' FROM p_name) AS both_ends, "
        "TRIM(LEADING 's' FROM p_name) AS leading_end, TRIM(TRAILING 't' FROM p_name) AS trailing_end, "
        "OVERLAY(p_name PLACING '##' FROM 2 FOR 3) AS overlaid, POSITION('i' IN p_name) AS found, "
        "TRANSLATE(p_name, 'aei', '432') AS translated, REGEXP_REPLACE(p_name, '[aeiou]+', '-') AS replaced FROM part",
        "SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS sub, TRIM(p_name, 's') AS both_ends, "
        "LTRIM(p_name, 's') AS leading_end, RTRIM(p_name, 't') AS trailing_end, "
        "SUBSTRING(p_name, 1, 1) || '##' || SUBSTRING(p_name, 5) AS overlaid, "
        "CAST(POSITION('i' IN p_name) AS INT) AS found, "
        "TRANSLATE(p_name, 'aei', '432') AS translated, REGEXP_REPLACE(p_name, '[aeiou]+', '-', 'g') AS replaced FROM part",
    ),
    "f_soundex": (["customer"], "SELECT c_custkey, SOUNDEX(c_mktsegment) AS code FROM customer"),
    "f_date": (
        ["events"],
        "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, "
        "UNIX_TIMESTAMP(ts) AS seconds, ts >= TIMESTAMP '2024-01-15 12:00:00' AS late, "
        "CAST(CAST(ts AS DATE) + INTERVAL 3 DAY AS STRING) AS three_on, DATE '2024-02-01' > CAST(ts AS DATE) AS in_january, "
        "DATE_FORMAT(ts + INTERVAL 90 MINUTE, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS later FROM events",
        "SELECT event_id, CAST(YEAR(ts) AS INT) AS y, CAST(MONTH(ts) AS INT) AS m, CAST(EXTRACT(DAY FROM ts) AS INT) AS d, "
        "CAST(EXTRACT(HOUR FROM ts) AS INT) AS h, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS seconds, "
        "ts >= TIMESTAMP '2024-01-15 12:00:00' AS late, CAST(CAST(CAST(ts AS DATE) + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS three_on, "
        "DATE '2024-02-01' > CAST(ts AS DATE) AS in_january, "
        "strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS later FROM events",
    ),
    "f_math": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, FLOOR(l_extendedprice) AS low, CEIL(l_extendedprice) AS high FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(FLOOR(l_extendedprice) AS BIGINT) AS low, "
        "CAST(CEIL(l_extendedprice) AS BIGINT) AS high FROM lineitem",
    ),
    "f_cast": (
        ["events"],
        "SELECT event_id, CAST(user_id AS STRING) AS as_text, CAST(value AS INT) AS as_int, "
        "TRY_CAST(event_type AS INT) AS none, CAST(CAST(event_id AS STRING) AS DOUBLE) AS as_double, "
        "CAST(CAST(ts AS DATE) AS STRING) AS as_day FROM events",
        "SELECT event_id, CAST(user_id AS VARCHAR) AS as_text, CAST(TRUNC(value) AS INT) AS as_int, "
        "TRY_CAST(event_type AS INT) AS none, CAST(CAST(event_id AS VARCHAR) AS DOUBLE) AS as_double, "
        "CAST(CAST(ts AS DATE) AS VARCHAR) AS as_day FROM events",
    ),
    "f_coalesce": (
        ["events"],
        "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none', 'never') AS kind, "
        "ISNULL(NULLIF(event_type, 'view')) AS missing, COALESCE(NULLIF(value, 0), -1) AS amount FROM events",
        "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none', 'never') AS kind, "
        "NULLIF(event_type, 'view') IS NULL AS missing, COALESCE(NULLIF(value, 0), -1) AS amount FROM events",
    ),
    "f_array": (
        ["embeddings"],
        "SELECT vec_id, SIZE(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS first_item, "
        "CAST(embedding[63] AS DOUBLE) AS last_item, ARRAY_CONTAINS(ARRAY(label, label + 1), 3) AS has_three, "
        "SIZE(ARRAY()) AS none, ARRAY_JOIN(ARRAY(CAST(label AS STRING), 'x'), '-') AS joined FROM embeddings",
        "SELECT vec_id, CAST(LEN(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first_item, "
        "CAST(embedding[64] AS DOUBLE) AS last_item, LIST_CONTAINS([label, label + 1], 3) AS has_three, "
        "CAST(LEN([]) AS INT) AS none, ARRAY_TO_STRING([CAST(label AS VARCHAR), 'x'], '-') AS joined FROM embeddings",
    ),
    "f_map": (
        ["events"],
        "SELECT event_id, m['type'] AS kind, m['user'] AS who, m['absent'] AS absent, SIZE(m) AS n FROM "
        "(SELECT event_id, MAP('type', event_type, 'user', CAST(user_id AS STRING)) AS m FROM events) e",
        "SELECT event_id, m['type'] AS kind, m['user'] AS who, m['absent'] AS absent, CAST(CARDINALITY(m) AS INT) AS n FROM "
        "(SELECT event_id, MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)} AS m FROM events) e",
    ),
    "f_struct": (
        ["orders"],
        "SELECT o_orderkey, s.status AS status, s.inner_part.price AS price, t.col2 AS second FROM "
        "(SELECT o_orderkey, NAMED_STRUCT('status', o_orderstatus, 'inner_part', NAMED_STRUCT('price', o_totalprice)) AS s, "
        "STRUCT(o_orderkey + 1, CONCAT(o_orderstatus, o_orderpriority)) AS t FROM orders) o",
        "SELECT o_orderkey, s.status AS status, s.inner_part.price AS price, t.col2 AS second FROM "
        "(SELECT o_orderkey, {'status': o_orderstatus, 'inner_part': {'price': o_totalprice}} AS s, "
        "{'col1': o_orderkey + 1, 'col2': o_orderstatus || o_orderpriority} AS t FROM orders) o",
    ),
    "f_json": (
        ["events"],
        "SELECT event_id, FROM_JSON(props, 'k INT').k AS k, GET_JSON_OBJECT(props, '$.k') AS k_text, "
        "TO_JSON(NAMED_STRUCT('id', event_id, 'tags', ARRAY(event_type, 'x'))) AS written FROM events",
        "SELECT event_id, CAST(props->>'$.k' AS INT) AS k, props->>'$.k' AS k_text, "
        "'{\"id\":' || event_id || ',\"tags\":[\"' || event_type || '\",\"x\"]}' AS written FROM events",
    ),
}

TOTALS = ViewDef(
    "OrderTotals",
    [Field("status", "string"), Field("n", "bigint"), Field("total", "double")],
    package="checks.sql",
)

TRANSFORM_TEXT = r"""
SET spark.sql.shuffle.partitions=4;
CREATE OR REPLACE TEMPORARY VIEW orders_of_year AS
  SELECT * FROM orders WHERE YEAR(o_orderdate) = ${year} AND o_orderpriority <> 'no\;such';
SELECT o_orderstatus AS status, COUNT(*) AS n,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders_of_year GROUP BY o_orderstatus
"""


def normalize_sql_query(spark, sf_dir):
    """Whole documents as query texts, quotes, comment lines and settings added to each."""
    text = F.concat(
        F.lit("-- header\nSET a.b=c;  SELECT 'two  blanks' ,\t\"q\tq\"\n  -- note\n"), "text", F.lit("\n WHERE x = 'it\\'s  ' ")
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize_sql(text)).alias("digest"))


def sql_transform_query(spark, sf_dir):
    with_views(spark, sf_dir, "orders")
    path = scratch_path(spark, "sql_transform")
    sql_transform(spark, TRANSFORM_TEXT, {"year": 1997}, write=lambda df: insert_into(df, TOTALS, path))
    return read_view(spark, TOTALS, path)


def sql_params(spark, sf_dir):
    with_views(spark, sf_dir, "orders")
    raw = substitute("SELECT o_orderkey, §{column} AS price FROM orders ", {"column": "o_totalprice"})
    return sql_transform(
        spark, raw + "WHERE o_orderstatus = :status AND o_totalprice > :low", args={"status": "F", "low": 200000}
    )


@F.pandas_udf(T.StringType())
def first_word(text: pd.Series) -> pd.Series:
    return text.str.split().str[0]


def register_udf(spark, sf_dir):
    with_views(spark, sf_dir, "part")
    register_functions(spark, {"first_word": first_word, "soundex": "unused.because.It.Exists"})
    return spark.sql("SELECT p_partkey, first_word(p_name) AS word, SOUNDEX('brand') AS code FROM part")


def _shout(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {"s_suppkey": batch["s_suppkey"], "line": batch["s_name"].str.upper() + "|" + batch["s_nationkey"].astype(str)}
    )


def row_mapper_query(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return row_mapper(rows, _shout, "s_suppkey long, line string")


def spark_sql_on_view(spark, sf_dir):
    segments = ViewDef("Segments", [Field("segment", "string"), Field("n", "bigint")], package="checks.sql")
    with_views(spark, sf_dir, "customer")
    path = scratch_path(spark, "spark_sql_on_view")
    result = spark.sql("SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
    insert_into(result, segments, path)
    return read_view(spark, segments, path)


def filter_project(spark, sf_dir):
    """A script of filter, project and store."""
    stations = ViewDef("Signups", [Field("id", "string"), Field("kind", "string")], package="checks.sql")
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "pig_filter_project")
    found = events.where(F.col("event_type").isin("signup", "purchase"))
    insert_into(found.select(F.col("event_id").alias("id"), F.substring("event_type", 1, 4).alias("kind")), stations, path)
    return read_view(spark, stations, path)


def run_then_export_query(spark, sf_dir):
    """One stored result, two exports of which one fails."""
    view = ViewDef("Balances", [Field("segment", "string"), Field("n", "bigint")], package="checks.sql")
    path, exported = scratch_path(spark, "stored"), scratch_path(spark, "exported")

    def write(df):
        write_view(df, view, path)
        return read_view(spark, view, path)

    def failing(df):
        raise OSError("target is away")

    result = (
        table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    )
    _, errors = run_then_export(result, write, [failing, lambda df: df.write.parquet(exported)])
    return spark.read.parquet(exported).withColumn("n_failed_exports", F.lit(len(errors)))


QUERIES = {name: run_sql(entry[1], *entry[0]) for name, entry in FUNCTIONS.items()}
QUERIES.update(
    {
        "normalize_sql": normalize_sql_query,
        "sql_transform": sql_transform_query,
        "sql_params": sql_params,
        "register_udf": register_udf,
        "row_mapper": row_mapper_query,
        "spark_sql_on_view": spark_sql_on_view,
        "pig_filter_project": filter_project,
        "run_then_export": run_then_export_query,
    }
)

ORACLE = {name: entry[2] for name, entry in FUNCTIONS.items() if len(entry) > 2}
ORACLE.update(
    {
        "f_soundex": "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'M256' WHEN 'BUILDING' THEN 'B435' "
        "WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' END AS code FROM customer",
        "normalize_sql": r"""
SELECT doc_id, md5(trim(array_to_string(list_transform(regexp_extract_all(regexp_replace(array_to_string(list_filter(
  list_transform(string_split('-- header' || chr(10) || 'SET a.b=c;  SELECT ''two  blanks'' ,' || chr(9) || '"q' || chr(9) || 'q"'
    || chr(10) || '  -- note' || chr(10) || text || chr(10) || ' WHERE x = ''it\''s  '' ', chr(10)),
    lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))),
  lambda l: l <> '' AND NOT starts_with(l, '--')), ' '), '(?i)( |^)SET [^;]+;', '', 'g'),
  '("[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|[^"''\\]+|\\.|["''\\])', 1),
  lambda p: CASE WHEN regexp_full_match(p, '(?s)["''].*["'']') THEN regexp_replace(p, '\s', ';', 'g')
                 ELSE regexp_replace(p, '\s+', ' ', 'g') END), ''))) AS digest FROM documents""",
        "sql_transform": "SELECT o_orderstatus AS status, COUNT(*) AS n, "
        "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders "
        "WHERE YEAR(o_orderdate) = 1997 GROUP BY o_orderstatus",
        "sql_params": "SELECT o_orderkey, o_totalprice AS price FROM orders "
        "WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
        "register_udf": "SELECT p_partkey, SPLIT_PART(p_name, ' ', 1) AS word, 'B653' AS code FROM part",
        "row_mapper": "SELECT s_suppkey, UPPER(s_name) || '|' || s_nationkey AS line FROM supplier",
        "spark_sql_on_view": "SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment",
        "pig_filter_project": "SELECT CAST(event_id AS VARCHAR) AS id, SUBSTRING(event_type, 1, 4) AS kind FROM events "
        "WHERE event_type IN ('signup', 'purchase')",
        "run_then_export": "SELECT c_mktsegment AS segment, COUNT(*) AS n, 1 AS n_failed_exports FROM customer "
        "GROUP BY c_mktsegment",
    }
)
