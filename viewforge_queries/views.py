"""Views, partitions and storage formats over the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from viewforge_queries.common import table
from viewforge.functions.dates import month_id, month_text, year_text
from viewforge.model import (
    Avro,
    Csv,
    Field,
    InOutputFormat,
    Json,
    Orc,
    Parquet,
    RegexText,
    SequenceFile,
    TextFile,
    ViewDef,
)
from viewforge.operators.views import (
    add_partitions,
    conform,
    insert_dynamically_into,
    insert_into,
    read_suffix_table,
    select_all,
    select_all_ordered,
    with_date_id,
    with_job_metadata,
    with_month_id,
    write_suffix_tables,
)
from viewforge.session import scratch_path
from viewforge.sources.files import ingest_files
from viewforge.sources.formats import read_view, write_view

CUSTOMERS = ViewDef(
    "Customers",
    [
        Field("cCustkey", "bigint"),
        Field("cName", "string"),
        Field("cAcctbal", "double"),
        Field("cMktsegment", "string"),
    ],
    package="checks.views",
    partitions=[Field("cNationkey", "int")],
)
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer"


def _round_trip(storage, label, **options):
    def query(spark, sf_dir):
        view = replace(CUSTOMERS, storage=storage, **options)
        path = scratch_path(spark, label)
        write_view(table(spark, sf_dir, "customer"), view, path)
        return read_view(spark, view, path)

    return query


# ---------------------------------------------------------------- nested delimited text

NESTED = ViewDef(
    "NestedEvents",
    [
        Field("id", "bigint"),
        Field("kinds", "array<string>"),
        Field("props", "map<string,int>"),
        Field("place", "struct<user:bigint,value:double>"),
        Field("steps", "array<struct<a:string,b:int>>"),
        Field("note", "string"),
    ],
    package="checks.views",
    storage=TextFile(field_terminator="\t", item_terminator=",", map_key_terminator=":"),
)


def nested_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.array("event_type", F.lit("e")).alias("kinds"),
        F.create_map(F.lit("k"), k, F.lit("twice"), k * 2).alias("props"),
        F.struct(F.col("user_id").alias("user"), F.col("value")).alias("place"),
        F.array(F.struct(F.col("event_type").alias("a"), k.alias("b"))).alias("steps"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("note"),
    )


def text_delimited(spark, sf_dir):
    path = scratch_path(spark, "text_delimited")
    write_view(nested_events(spark, sf_dir), NESTED, path)
    back = read_view(spark, NESTED, path)
    return back.select(
        "id",
        F.array_join("kinds", "+").alias("kinds"),
        F.col("props")["twice"].alias("twice"),
        F.col("place.user").alias("place_user"),
        F.col("place.value").alias("place_value"),
        F.col("steps")[0]["b"].alias("step_b"),
        "note",
    )


URLS = ViewDef(
    "Urls",
    [Field("scheme", "string"), Field("host", "string"), Field("path", "string")],
    package="checks.views",
    storage=RegexText(r"(https?)://([^/]+)/([^?#]*).*"),
)


def text_regex(spark, sf_dir):
    """Page urls and languages as lines; the languages do not match and give nulls."""
    path = scratch_path(spark, "text_regex")
    pages = table(spark, sf_dir, "pages")
    lines = pages.select(F.explode(F.array("url", F.substring_index("url", "/", -1))).alias("value"))
    lines.write.text(path)
    return read_view(spark, URLS, path)


FLAT_CUSTOMERS = replace(CUSTOMERS, fields=[*CUSTOMERS.fields, *CUSTOMERS.partitions], partitions=())


def _flat_round_trip(storage, label):
    def query(spark, sf_dir):
        view = replace(FLAT_CUSTOMERS, storage=storage)
        path = scratch_path(spark, label)
        write_view(table(spark, sf_dir, "customer"), view, path)
        return read_view(spark, view, path)

    return query


def ingest(spark, sf_dir):
    """Tab separated files in nested folders become one Parquet view."""
    source, target = scratch_path(spark, "ingest"), scratch_path(spark, "ingested")
    rows = conform(table(spark, sf_dir, "customer"), FLAT_CUSTOMERS)
    for folder, condition in (("low/a", F.col("c_acctbal") < 1000), ("high", F.col("c_acctbal") >= 1000)):
        rows.where(condition).write.csv(f"{source}/{folder}", sep="\t", nullValue="\\N")
    return ingest_files(spark, source, FLAT_CUSTOMERS, target, recursive=True)


# ---------------------------------------------------------------- partitions

ORDERS = ViewDef(
    "Orders",
    [Field("id", "bigint"), Field("custkey", "bigint"), Field("price", "double")],
    package="checks.views",
    partitions=[Field("year", "string"), Field("month", "string")],
)


def _orders(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("price"),
        year_text(at).alias("year"),
        month_text(at).alias("month"),
    )


ORDERS_SQL = (
    "SELECT o_orderkey AS id, o_custkey AS custkey, o_totalprice AS price, strftime(o_orderdate, '%Y') AS year, "
    "strftime(o_orderdate, '%m') AS month FROM orders"
)


def insert_static(spark, sf_dir):
    """All months, then one of them again with other prices."""
    path = scratch_path(spark, "insert_static")
    rows = _orders(spark, sf_dir)
    write_view(rows, ORDERS, path)
    again = rows.where((F.col("year") == "1996") & (F.col("month") == "03")).withColumn("price", -F.col("price"))
    insert_into(again, ORDERS, path, {"year": "1996", "month": "03"})
    return read_view(spark, ORDERS, path)


def insert_dynamic(spark, sf_dir):
    """All months, then those of one year again."""
    path = scratch_path(spark, "insert_dynamic")
    rows = _orders(spark, sf_dir)
    write_view(rows, ORDERS, path)
    again = rows.where(F.col("year") == "1997").withColumn("price", F.col("price") + 1)
    insert_dynamically_into(again, ORDERS, path)
    return read_view(spark, ORDERS, path)


def insert_table(spark, sf_dir):
    """A second overwrite replaces everything the first wrote."""
    path = scratch_path(spark, "insert_table")
    rows = table(spark, sf_dir, "customer")
    insert_into(rows, CUSTOMERS, path)
    insert_into(rows.where(F.col("c_acctbal") > 0), CUSTOMERS, path)
    return read_view(spark, CUSTOMERS, path)


def split_by_suffix(spark, sf_dir):
    """One table per market segment; each row says from which table it was read."""
    view = ViewDef(
        "CustomerOf",
        [Field("cCustkey", "bigint"), Field("cName", "string")],
        package="checks.views",
        suffixes=[Field("cMktsegment", "string")],
    )
    root = scratch_path(spark, "split_by_suffix")
    written = write_suffix_tables(table(spark, sf_dir, "customer"), view, root)
    parts = None
    # One row per table: the names of a handful of tables.
    for segment in sorted(r.c_mktsegment for r in written.select("c_mktsegment").collect()):
        one = read_suffix_table(spark, view, root, [segment]).withColumn("table_name", F.lit(view.table_name([segment])))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def read_partition(spark, sf_dir):
    path = scratch_path(spark, "read_partition")
    write_view(_orders(spark, sf_dir), ORDERS, path)
    return select_all(spark, ORDERS, path, {"year": "1998", "month": "07"})


def read_partition_ordered(spark, sf_dir):
    path = scratch_path(spark, "read_partition_ordered")
    write_view(table(spark, sf_dir, "customer"), CUSTOMERS, path)
    return select_all_ordered(spark, CUSTOMERS, path, {"c_nationkey": 7}, "c_acctbal")


def add_partitions_query(spark, sf_dir):
    """Months from 1998 on are wanted; those up to 1999 are known."""
    at = F.col("o_orderdate")
    months = table(spark, sf_dir, "orders").groupBy(month_id(at).alias("partition")).agg(
        F.max("o_orderkey").alias("ts")
    )
    state = months.where(F.col("partition") < "200001").select(
        F.lit("orders").alias("view"), "partition", F.md5("partition").alias("checksum"), "ts"
    )
    wanted = months.where(F.col("partition") >= "199801").select(F.lit("orders").alias("view"), "partition")
    return add_partitions(state, wanted)


def conform_to_view(spark, sf_dir):
    """Weights order the columns, names are rewritten, types are cast."""
    view = ViewDef(
        "Order",
        [
            Field("createdBy", "string", weight=0),
            Field("orderStatus", "string"),
            Field("id", "string", weight=2147483647),
            Field("totalPrice", "int"),
        ],
        package="checks.views",
        partitions=[Field("orderYear", "int")],
    )
    rows = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("order_year"),
        F.floor("o_totalprice").alias("total_price"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderkey").alias("id"),
        F.lit("job").alias("created_by"),
    )
    return conform(rows, view)


def job_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return with_job_metadata(rows, "2024-05-01T10:00:00.000Z", "nightly")


def partition_date_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    months = with_month_id(orders, "o_orderdate").withColumnsRenamed({"year": "m_year", "month": "m_month"})
    return with_date_id(months, "o_orderdate").drop("o_orderdate")


QUERIES = {
    "fmt_parquet": _round_trip(Parquet(), "parquet"),
    "fmt_orc": _round_trip(Orc(), "orc", write_options={"compression": "zlib"}),
    "fmt_json": _round_trip(Json(), "json"),
    "fmt_csv": _round_trip(Csv(separator=";", quote="'", escape="\\"), "csv"),
    "fmt_avro": _round_trip(Avro("customers.avsc"), "avro"),
    "fmt_text_opencsv": _round_trip(Csv(separator="\t", quote='"', escape="\\"), "opencsv"),
    "fmt_text_delimited": text_delimited,
    "fmt_text_regex": text_regex,
    "fmt_sequence": _flat_round_trip(SequenceFile(TextFile()), "sequence"),
    "fmt_in_out_format": _flat_round_trip(
        InOutputFormat("org.apache.hadoop.mapred.TextInputFormat", "org.apache.hadoop.mapred.TextOutputFormat"),
        "in_out_format",
    ),
    "ingest_files": ingest,
    "conform_to_view": conform_to_view,
    "with_job_metadata": job_metadata,
    "insert_overwrite_static": insert_static,
    "insert_overwrite_dynamic": insert_dynamic,
    "insert_overwrite_table": insert_table,
    "split_by_suffix": split_by_suffix,
    "read_partition": read_partition,
    "read_partition_ordered": read_partition_ordered,
    "add_partitions": add_partitions_query,
    "partition_date_columns": partition_date_columns,
}

ORACLE = {
    **{f"fmt_{f}": CUSTOMER_SQL for f in ("parquet", "orc", "json", "csv", "avro", "text_opencsv", "sequence", "in_out_format")},
    "fmt_text_delimited": "SELECT event_id AS id, event_type || '+e' AS kinds, CAST(props->>'$.k' AS INT) * 2 AS twice, "
    "user_id AS place_user, value AS place_value, CAST(props->>'$.k' AS INT) AS step_b, "
    "NULLIF(event_type, 'click') AS note FROM events",
    "fmt_text_regex": "SELECT CASE WHEN ok THEN regexp_extract(line, p, 1) END AS scheme, "
    "CASE WHEN ok THEN regexp_extract(line, p, 2) END AS host, CASE WHEN ok THEN regexp_extract(line, p, 3) END AS path "
    "FROM (SELECT line, p, regexp_full_match(line, p) AS ok FROM (SELECT line, '(https?)://([^/]+)/([^?#]*).*' AS p FROM "
    "(SELECT url AS line FROM pages UNION ALL SELECT list_extract(string_split(url, '/'), -1) AS line FROM pages) a) b) c",
    "ingest_files": CUSTOMER_SQL,
    "conform_to_view": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS order_status, "
    "CAST(FLOOR(o_totalprice) AS INT) AS total_price, 'job' AS created_by, CAST(YEAR(o_orderdate) AS INT) AS order_year FROM orders",
    "with_job_metadata": "SELECT s_suppkey, s_name, '2024-05-01T10:00:00.000Z' AS created_at, 'nightly' AS created_by FROM supplier",
    "insert_overwrite_static": f"SELECT id, custkey, CASE WHEN year = '1996' AND month = '03' THEN -price ELSE price END AS price, "
    f"year, month FROM ({ORDERS_SQL}) o",
    "insert_overwrite_dynamic": f"SELECT id, custkey, CASE WHEN year = '1997' THEN price + 1 ELSE price END AS price, "
    f"year, month FROM ({ORDERS_SQL}) o",
    "insert_overwrite_table": CUSTOMER_SQL + " WHERE c_acctbal > 0",
    "split_by_suffix": "SELECT c_custkey, c_name, 'dev_checks_views.customer_of_' || LOWER(c_mktsegment) AS table_name FROM customer",
    "read_partition": ORDERS_SQL + " WHERE strftime(o_orderdate, '%Y%m') = '199807'",
    "read_partition_ordered": CUSTOMER_SQL + " WHERE c_nationkey = 7",
    "add_partitions": "SELECT 'orders' AS view, ym AS partition, CASE WHEN ym < '200001' THEN md5(ym) ELSE '0' END AS checksum, "
    "CASE WHEN ym < '200001' THEN ts ELSE 0 END AS ts FROM (SELECT strftime(o_orderdate, '%Y%m') AS ym, "
    "MAX(o_orderkey) AS ts FROM orders GROUP BY 1) m",
    "partition_date_columns": "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS m_year, strftime(o_orderdate, '%m') AS m_month, "
    "strftime(o_orderdate, '%Y%m') AS month_id, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, "
    "strftime(o_orderdate, '%d') AS day, strftime(o_orderdate, '%Y%m%d') AS date_id FROM orders",
}
