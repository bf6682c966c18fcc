"""Export encoders over whole tables, and writers with clients that append to files."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from viewforge_queries.common import table
from viewforge.exports import files, jdbc, kv, message, warehouse
from viewforge.exports.common import FILE_WRITERS, export_counters, partition_filter_column, partition_filter_text
from viewforge.functions.dates import date_id, month_id, month_text, year_text
from viewforge.functions.digests import anonymize, complex_to_json
from viewforge.session import scratch_path
from viewforge.sources.files import copy_file, distributed_copy, open_uri

SALT = "vD75MqvaasIlCf7H"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def _events(spark, sf_dir):
    """Events with a map, an array, a struct, and a type that is sometimes missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.create_map(F.lit("k"), k, F.lit("none"), F.lit(None).cast("int")).alias("props"),
        F.array(F.array(k, F.lit(None).cast("int")), F.array(k + 1)).alias("numbers"),
        F.struct(F.col("user_id").alias("user"), F.nullif(F.col("event_type"), F.lit("view")).alias("seen")).alias("who"),
    )


def anonymize_query(spark, sf_dir):
    rows = _customers(spark, sf_dir).select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return anonymize(rows, ["c_name", "segment"])


def complex_to_json_query(spark, sf_dir):
    return complex_to_json(_events(spark, sf_dir))


def export_counters_query(spark, sf_dir):
    return export_counters(_events(spark, sf_dir), "kind")


def _monthly_orders(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("customer"),
        F.array("o_orderstatus", "o_orderpriority").alias("marks"),
        year_text(at).alias("year"),
        month_text(at).alias("month"),
    )


def jdbc_encode_query(spark, sf_dir):
    text = partition_filter_text({"source": "orders", "run": "2024 05"})
    return jdbc.jdbc_encode(_monthly_orders(spark, sf_dir), text, private=["customer"], salt=SALT)


def kv_encode_string(spark, sf_dir):
    rows = _customers(spark, sf_dir).withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return kv.kv_encode_string(rows, "c_custkey", "segment", prefix="segment", private=["segment"], salt=SALT)


def _exported(spark, sf_dir, path, rows, filter_text):
    """Rows of one export as its temporary table holds them, with one task's rows inserted twice."""

    def write(numbered, url, name):
        numbered.write.parquet(path)
        numbered.where(F.col("export_row") % 3 == 0).write.mode("append").parquet(path)

    jdbc.jdbc_export(rows, "jdbc:derby:memory:none", "db", "t", lambda s: None, lambda t: False, filter_text, write=write)
    return spark.read.parquet(path)


def jdbc_write_query(spark, sf_dir):
    """Encoded, numbered and stored; the repeated rows count once."""
    staged = _exported(spark, sf_dir, scratch_path(spark, "jdbc_write"), table(spark, sf_dir, "orders"), "status = 'all'")
    return jdbc.merged_rows(None, staged, "status = 'all'")


def jdbc_merge_commit(spark, sf_dir):
    """A partition per status is in the target; one of them is exported again."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = None
    for status, factor in (("O", 1), ("F", 1), ("P", 1), ("F", -1)):
        text = f"status = '{status}'"
        part = rows.where(F.col("o_orderstatus") == status).withColumn("o_totalprice", F.col("o_totalprice") * factor)
        staged = _exported(spark, sf_dir, scratch_path(spark, "jdbc_merge"), part, text)
        target = jdbc.merged_rows(target, staged, text)
    return target


def _map_text(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def kv_encode_hash(spark, sf_dir):
    """Maps keep nulls as text, structs leave them out."""
    rows = _events(spark, sf_dir)
    maps = kv.kv_encode_hash(rows, "id", "props", prefix="map")
    structs = kv.kv_encode_hash(rows, "id", "who", prefix="struct")
    return maps.unionByName(structs).withColumn("value", _map_text("value"))


def kv_encode_list(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x * 1000)).alias("items")
    )
    return kv.kv_encode_list(rows, "vec_id", "items").withColumn("value", F.array_join("value", ","))


def kv_encode_row(spark, sf_dir):
    rows = _customers(spark, sf_dir).select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.array("c_nationkey").alias("places")
    )
    encoded = kv.kv_encode_row(rows, "c_custkey", prefix="customer", private=["c_name"], salt=SALT)
    return encoded.withColumn("value", _map_text("value"))


class FileKeyValueClient:
    """Keeps what it is sent in one file per connection."""

    def __init__(self, folder: str):
        system, path = open_uri(folder)
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{uuid.uuid4().hex}.json")

    def _line(self, entry):
        self.out.write(json.dumps(entry).encode() + b"\n")

    def delete(self, keys):
        self._line({"op": "delete", "n": len(keys)})

    def put(self, items):
        for key, value in items:
            self._line({"op": "put", "key": key, "value": value})

    def send(self, topic, items):
        for key, value in items:
            self._line({"topic": topic, "key": key, "value": value})

    def flush(self):
        self.out.flush()

    def close(self):
        self.out.close()


def kv_write_query(spark, sf_dir):
    folder = scratch_path(spark, "kv_write")
    kv.kv_write(kv_encode_string(spark, sf_dir), lambda: FileKeyValueClient(folder), writers=4, batch_rows=100)
    return spark.read.schema("op string, key string, value string").json(folder).where("op = 'put'").select("key", "value")


def message_encode_query(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return message.message_encode(rows, "id", private=["kind"], salt=SALT)


def message_encode_avro(spark, sf_dir):
    encoded = message.message_encode_avro(_events(spark, sf_dir), "id", "event", columns_only=True)
    return encoded.select("key", F.hex("value").alias("value"))


def message_write_query(spark, sf_dir):
    folder = scratch_path(spark, "message_write")
    encoded = message.message_encode(_customers(spark, sf_dir).select("c_custkey", "c_name"), "c_custkey")
    message.message_write(
        encoded, message.topic_name("db", "customer"), lambda: FileKeyValueClient(folder), writers=4, batch_rows=200
    )
    return spark.read.schema("topic string, key string, value string").json(folder)


def export_csv_query(spark, sf_dir):
    """Written with quotes and compression, read back as text."""
    path = scratch_path(spark, "export_csv")
    rows = _customers(spark, sf_dir).select(
        "c_custkey",
        F.concat(F.lit(' say "'), "c_name", F.lit('" ')).alias("c_name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.array("c_nationkey").alias("places"),
    )
    files.export_csv(rows, path, header=False)
    return spark.read.text(path)


def export_json_lines_query(spark, sf_dir):
    path = scratch_path(spark, "export_json_lines")
    files.export_json_lines(_events(spark, sf_dir), path)
    return spark.read.text(path)


class FolderUploader:
    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, source: str, remote: str) -> None:
        copy_file(source, f"{self.folder}/{remote}")


def upload_files_query(spark, sf_dir):
    """A local folder stands for the remote server."""
    remote = scratch_path(spark, "remote")
    rows = _customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    files.upload_files(
        rows,
        scratch_path(spark, "upload"),
        lambda: FolderUploader(remote),
        files.remote_prefix("db", "customer"),
        datetime(2024, 5, 1, 10),
        writers=FILE_WRITERS,
        header=False,
    )
    return spark.read.schema("c_custkey long, c_mktsegment string").csv(remote, sep="\t")


def warehouse_encode_query(spark, sf_dir):
    return warehouse.warehouse_encode(_events(spark, sf_dir), "year = '2024'", private=["kind"], salt=SALT)


class RecordingWarehouse:
    """Remembers the calls and keeps the loaded files by copying them."""

    def __init__(self, spark, kept: str):
        self.spark, self.kept, self.calls = spark, kept, []

    def drop_partition(self, target):
        self.calls.append(("drop", target))

    def create_table(self, target, schema):
        self.calls.append(("create", target))

    def load(self, target, location):
        self.calls.append(("load", target))
        distributed_copy(self.spark, [location], self.kept, max_tasks=4)

    def remove_files(self, location):
        self.calls.append(("remove", location))


def warehouse_write_query(spark, sf_dir):
    kept = scratch_path(spark, "warehouse")
    client = RecordingWarehouse(spark, kept)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    warehouse.warehouse_write(rows, scratch_path(spark, "staging"), "orders$20240501", client, writers=3)
    return spark.read.text(kept)


def warehouse_target_query(spark, sf_dir):
    at = F.col("o_orderdate")
    partitions = (
        table(spark, sf_dir, "orders")
        .select(
            year_text(at).alias("year"),
            month_text(at).alias("month"),
            month_id(at).alias("month_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("class"),
        )
        .distinct()
    )
    return partitions.select(
        "month_id",
        "status",
        "class",
        warehouse.warehouse_target_columns("orders", ["year", "month", "month_id", "status", "class"]).alias("target"),
    )


def export_partition_filter(spark, sf_dir):
    at = F.col("o_orderdate")
    partitions = table(spark, sf_dir, "orders").select(year_text(at).alias("year"), date_id(at).alias("date_id")).distinct()
    return partitions.select("year", "date_id", partition_filter_column(["year", "date_id"]).alias("filter_text"))


def distributed_copy_query(spark, sf_dir):
    """Customers written per nation, copied, and read from the copy."""
    source, target = scratch_path(spark, "source"), scratch_path(spark, "target")
    table(spark, sf_dir, "customer").write.partitionBy("c_mktsegment").parquet(source)
    distributed_copy(spark, [source], target, max_tasks=8)
    return spark.read.parquet(target).select("c_custkey", "c_name", "c_mktsegment")


QUERIES = {
    "distributed_copy": distributed_copy_query,
    "anonymize": anonymize_query,
    "complex_to_json": complex_to_json_query,
    "export_counters": export_counters_query,
    "jdbc_encode": jdbc_encode_query,
    "jdbc_write": jdbc_write_query,
    "jdbc_merge_commit": jdbc_merge_commit,
    "kv_encode_string": kv_encode_string,
    "kv_encode_hash": kv_encode_hash,
    "kv_encode_list": kv_encode_list,
    "kv_encode_row": kv_encode_row,
    "kv_write": kv_write_query,
    "message_encode": message_encode_query,
    "message_encode_avro": message_encode_avro,
    "message_write": message_write_query,
    "export_csv": export_csv_query,
    "export_json_lines": export_json_lines_query,
    "upload_files": upload_files_query,
    "warehouse_encode": warehouse_encode_query,
    "warehouse_write": warehouse_write_query,
    "warehouse_target": warehouse_target_query,
    "export_partition_filter": export_partition_filter,
}

EVENTS_SQL = (
    "(SELECT event_id AS id, NULLIF(event_type, 'error') AS kind, CAST(props->>'$.k' AS INT) AS k, user_id, "
    "NULLIF(event_type, 'view') AS seen FROM events)"
)
WHO_JSON = "'{\"user\":' || user_id || ',\"seen\":' || COALESCE('\"' || seen || '\"', 'null') || '}'"
HASHED_KIND = f"md5(kind || '{SALT}')"
MESSAGE_SQL = (
    "SELECT CAST(id AS VARCHAR) AS key, '{\"id\":' || id || ',\"kind\":' || COALESCE('\"' || "
    "{kind} || '\"', 'null') || ',\"props\":{\"k\":' || k || '},\"numbers\":[' || k || ',' || (k + 1) || '],\"who\":' || "
    f"{WHO_JSON} || '}}' AS value FROM {EVENTS_SQL} e"
)
SEGMENT = "NULLIF(c_mktsegment, 'BUILDING')"
STRING_SQL = (
    f"SELECT 'segment_' || c_custkey AS key, md5(c_mktsegment || '{SALT}') AS value FROM customer "
    f"WHERE {SEGMENT} IS NOT NULL"
)

# Zigzag bytes of a whole number below 2**20, and a text after its length, as hexadecimal digits.
def _number_hex(n: str) -> str:
    return (
        f"CASE WHEN ({n}) * 2 < 128 THEN printf('%02X', ({n}) * 2) "
        f"WHEN ({n}) * 2 < 16384 THEN printf('%02X%02X', (({n}) * 2) % 128 + 128, (({n}) * 2) // 128) "
        f"ELSE printf('%02X%02X%02X', (({n}) * 2) % 128 + 128, ((({n}) * 2) // 128) % 128 + 128, (({n}) * 2) // 16384) END"
    )


def _text_hex(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN '00' ELSE '02' || printf('%02X', length({text}) * 2) || hex({text}) END"


ORACLE = {
    "distributed_copy": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "anonymize": f"SELECT c_custkey, md5(c_name || '{SALT}') AS c_name, md5({SEGMENT} || '{SALT}') AS segment FROM customer",
    "complex_to_json": "SELECT CAST(id AS VARCHAR) AS id, kind, '{\"k\":' || k || ',\"none\":null}' AS props, "
    f"'[[' || k || ',null],[' || (k + 1) || ']]' AS numbers, {WHO_JSON} AS who FROM {EVENTS_SQL} e",
    "export_counters": "SELECT COUNT(NULLIF(event_type, 'error')) AS success, "
    "COUNT(*) FILTER (event_type = 'error') AS failed FROM events",
    "jdbc_encode": f"SELECT o_orderkey, md5(o_custkey || '{SALT}') AS customer, "
    "'[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS marks, strftime(o_orderdate, '%Y') AS data_year, "
    "strftime(o_orderdate, '%m') AS data_month, 'source=ordersandrun=202405' AS used_filter FROM orders",
    "jdbc_write": "SELECT *, 'status=all' AS used_filter FROM orders",
    "jdbc_merge_commit": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END "
    "AS o_totalprice, 'status=' || o_orderstatus AS used_filter FROM orders",
    "kv_encode_string": STRING_SQL,
    "kv_write": STRING_SQL,
    "kv_encode_hash": f"SELECT 'map_' || id AS key, 'k=' || k || ',none=null' AS value FROM {EVENTS_SQL} e UNION ALL "
    f"SELECT 'struct_' || id AS key, COALESCE('seen=' || seen || ',', '') || 'user=' || user_id AS value FROM {EVENTS_SQL} e",
    "kv_encode_list": "SELECT CAST(vec_id AS VARCHAR) AS key, array_to_string(list_transform(list_reverse(embedding), "
    "lambda x: CAST(CAST(FLOOR(x * 1000) AS BIGINT) AS VARCHAR)), ',') AS value FROM embeddings",
    "kv_encode_row": "SELECT 'customer_' || c_custkey AS key, 'c_custkey=' || c_custkey || ',c_name=' || "
    f"md5(c_name || '{SALT}') || ',places=[' || c_nationkey || ']' || COALESCE(',segment=' || {SEGMENT}, '') AS value FROM customer",
    "message_encode": MESSAGE_SQL.replace("{kind}", HASHED_KIND),
    "message_encode_avro": f"SELECT CAST(id AS VARCHAR) AS key, '02' || {_number_hex('id')} || {_text_hex('kind')} || "
    f"'0202026B02' || {_number_hex('k')} || '00' || '020402' || {_number_hex('k')} || '02' || {_number_hex('k + 1')} || '00' || "
    f"'0202' || {_number_hex('user_id')} || {_text_hex('seen')} AS value FROM {EVENTS_SQL} e",
    "message_write": "SELECT 'db_customer' AS topic, CAST(c_custkey AS VARCHAR) AS key, "
    "'{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS value FROM customer",
    "export_csv": "SELECT '\"' || c_custkey || '\"' || chr(9) || '\"say \"\"' || c_name || '\"\"\"' || chr(9) || '\"' || "
    f"COALESCE({SEGMENT}, '') || '\"' || chr(9) || '\"[' || c_nationkey || ']\"' AS value FROM customer",
    "export_json_lines": "SELECT value FROM (" + MESSAGE_SQL.replace("{kind}", "kind") + ") m",
    "upload_files": "SELECT c_custkey, c_mktsegment FROM customer",
    "warehouse_encode": "SELECT '{\"_USED_HCAT_FILTER\":\"year = ''2024''\",\"id\":' || id || "
    f"COALESCE(',\"kind\":\"' || {HASHED_KIND} || '\"', '') || ',\"props\":\"{{\\\"k\\\":' || k || "
    "',\\\"none\\\":null}\",\"numbers\":[\"[' || k || ',null]\",\"[' || (k + 1) || ']\"],\"who\":{\"user\":' || user_id || COALESCE(',\"seen\":\"' || seen || '\"', '') || '}}' AS value "
    f"FROM {EVENTS_SQL} e",
    "warehouse_write": "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS value "
    "FROM orders",
    "warehouse_target": "SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month_id, o_orderstatus AS status, "
    "o_orderpriority AS class, 'orders_' || lower(o_orderpriority || '_' || o_orderstatus) || '$' || "
    "strftime(o_orderdate, '%Y%m01') AS target FROM orders",
    "export_partition_filter": "SELECT DISTINCT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y%m%d') AS date_id, "
    "'year = ''' || strftime(o_orderdate, '%Y') || ''' and date_id = ''' || strftime(o_orderdate, '%Y%m%d') || '''' "
    "AS filter_text FROM orders",
}
