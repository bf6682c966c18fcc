"""Exports: schemas, encoders, writers with recording clients."""

from __future__ import annotations

import gzip
import json
import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge_queries.exports import FileKeyValueClient, FolderUploader
from viewforge.exports import files, jdbc, kv, message, warehouse
from viewforge.exports.common import batches, check_key_and_value, export_counters, partition_filter_text
from viewforge.session import shared_dir

SALT = "vD75MqvaasIlCf7H"


def test_batches():
    assert [len(b) for b in batches(range(25), 10)] == [10, 10, 5]


def test_keys_and_values(spark):
    schema = spark.createDataFrame([], "k string, m map<string,array<int>>, a array<int>, s struct<x:int>").schema
    check_key_and_value(schema, "k", "a")
    check_key_and_value(schema, "k", "s")
    for key, value in (("a", None), ("k", "m")):
        with pytest.raises(ValueError):
            check_key_and_value(schema, key, value)


def test_counters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert export_counters(df, "v").collect() == [(1, 1)]


# ---------------------------------------------------------------- databases


@pytest.mark.parametrize(
    "url, text, small",
    [
        ("jdbc:mysql://h/d", "text", "tinyint"),
        ("jdbc:postgresql://h/d", "text", "smallint"),
        ("jdbc:exa:h", "varchar(100000)", "int"),
        ("jdbc:derby:memory:x", "varchar(32000)", "int"),
    ],
)
def test_database_types(spark, url, text, small):
    schema = spark.createDataFrame(
        [], "s string, t tinyint, a array<int>, ts timestamp, d date, n decimal(10,2)"
    ).schema
    kinds = jdbc.column_types(schema, jdbc.dialect_of(url))
    assert kinds == {"s": text, "t": small, "a": text, "ts": "timestamp", "d": "date", "n": "decimal(10,2)"}


def test_database_types_refuse_the_unknown(spark):
    with pytest.raises(ValueError):
        jdbc.column_types(T.StructType([T.StructField("b", T.BinaryType())]), "mysql")
    with pytest.raises(ValueError):
        jdbc.dialect_of("jdbc:other:x")


def test_create_statements():
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert jdbc.create_statement("t", schema, "mysql") == "CREATE TABLE t (a int) ENGINE=InnoDB DEFAULT CHARSET=utf8"
    assert jdbc.create_statement("t", schema, "exasol", distribute_by="a") == "CREATE TABLE t (a int, DISTRIBUTE BY a)"
    assert jdbc.create_statement("t", schema, "derby") == "CREATE TABLE t (a int)"


def test_merge_replaces_one_partition_or_the_table():
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("used_filter", T.StringType())])
    insert = (
        "INSERT INTO t (a, used_filter) SELECT a, used_filter FROM (SELECT DISTINCT export_row, a, used_filter FROM tmp) numbered"
    )
    text = partition_filter_text({"year": "2014", "month": "10"})
    assert text == "year = '2014' and month = '10'"
    assert jdbc.merge_statements("t", "tmp", schema, "derby", True, text) == [
        "DELETE FROM t WHERE used_filter = 'year=2014andmonth=10'",
        insert,
        "DROP TABLE tmp",
    ]
    whole = jdbc.merge_statements("t", "tmp", schema, "derby", True)
    assert whole[0] == "DROP TABLE t" and whole[1].startswith("CREATE TABLE t") and whole[2] == insert
    assert jdbc.merge_statements("t", "tmp", schema, "derby", False, text)[0].startswith("CREATE TABLE t")


class RecordingDatabase:
    """Keeps statements and written rows; can fail while rows are written."""

    def __init__(self, tables=(), fails=False):
        self.tables, self.fails, self.statements, self.rows = set(tables), fails, [], []

    def exists(self, table):
        return table in self.tables

    def execute(self, statements):
        for s in statements:
            self.statements.append(s)
            words = s.split()
            if words[0] == "CREATE":
                self.tables.add(words[2])
            elif words[0] == "DROP":
                self.tables.discard(words[2])

    def write(self, rows, url, table):
        if self.fails:
            raise OSError("connection lost")
        assert table in self.tables
        self.rows = rows.collect()


def test_database_export(spark):
    df = spark.createDataFrame([(1, "2014", ["x"]), (2, "2014", None)], "id int, year string, tags array<string>")
    # A temporary table per filter: one of another export stays, a leftover of this one goes.
    temporary = jdbc.temporary_table("db_t", "year = '2014'")
    database = RecordingDatabase({"db_t", "tmp_db_t", temporary})
    counts = jdbc.jdbc_export(
        df, "jdbc:derby:memory:x", "db", "t", database.execute, database.exists, "year = '2014'", ["id"], SALT, database.write
    )
    assert database.statements[0] == f"DROP TABLE {temporary}" and counts == {"success": 2, "failed": 0}
    assert database.statements[2] == "DELETE FROM db_t WHERE used_filter = 'year=2014'"
    assert database.tables == {"db_t", "tmp_db_t"}
    assert len({jdbc.temporary_table("db_t", f) for f in (None, "year = '2014'", "year = '2015'")}) == 3
    rows = sorted(database.rows, key=lambda r: str(r.tags))
    assert rows[0].asDict().keys() == {"id", "data_year", "tags", "used_filter", "export_row"}
    assert len(rows[0].id) == 32 and {r.tags for r in rows} == {None, '["x"]'}
    assert len({r.export_row for r in rows}) == 2


def test_failed_database_export_drops_its_temporary_table(spark):
    database = RecordingDatabase({"db_t"}, fails=True)
    with pytest.raises(OSError):
        jdbc.jdbc_export(
            spark.range(3), "jdbc:derby:memory:x", "db", "t", database.execute, database.exists, write=database.write
        )
    assert database.tables == {"db_t"}


# ---------------------------------------------------------------- key-value stores


def test_key_value_encoders(spark):
    df = spark.createDataFrame(
        [("k1", "v", {"a": 1, "b": None}, ["x", "y"], (1, None)), ("k2", None, None, None, (None, None))],
        "k string, v string, m map<string,int>, l array<string>, s struct<p:int,q:string>",
    )
    assert kv.kv_encode_string(df, "k", "v", "pre").collect() == [("pre_k1", "v")]
    hashed = kv.kv_encode_string(df, "k", "v", private=["v", "k"], salt=SALT).collect()[0]
    assert hashed.key == "k1" and len(hashed.value) == 32
    assert kv.kv_encode_hash(df, "k", "m").collect() == [("k1", {"a": "1", "b": "null"})]
    assert kv.kv_encode_hash(df, "k", "s").collect() == [("k1", {"p": "1"})]
    assert kv.kv_encode_list(df, "k", "l").collect() == [("k1", ["y", "x"])]
    whole = {r.key: r.value for r in kv.kv_encode_row(df, "k", private=["v"], salt=SALT).collect()}
    assert whole["k2"] == {"k": "k2", "s": '{"p":null,"q":null}'}
    assert whole["k1"]["l"] == '["x","y"]' and len(whole["k1"]["v"]) == 32


def test_key_value_golden(spark):
    key, value = "0000434c-aa04-449d-b6d5-319da5d94064", "2016-02-09T12:21:24.581+01:00"
    df = spark.createDataFrame([(key, value)], "id string, created_at string")
    assert kv.kv_encode_string(df, "id", "created_at", "string_export").collect() == [(f"string_export_{key}", value)]


def test_key_value_write(spark, tmp_path):
    flushed = []
    df = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    folder = str(tmp_path / "kv")
    counts = kv.kv_write(df, lambda: FileKeyValueClient(folder), writers=3, batch_rows=7, flush=lambda: flushed.append(1))
    assert counts == {"success": 50, "failed": 0}
    lines = [json.loads(line) for p in (tmp_path / "kv").iterdir() for line in p.read_text().splitlines()]
    puts = [x["key"] for x in lines if x["op"] == "put"]
    assert sorted(puts, key=int) == [str(i) for i in range(50)] and flushed == [1]
    deletes = [x["n"] for x in lines if x["op"] == "delete"]
    assert sum(deletes) == 50 and max(deletes) <= 7


@pytest.mark.parametrize(("writers", "batch_rows"), [(1, 1), (1, 2), (4, 1), (4, 10)])
def test_replaced_keys_depend_on_neither_batches_nor_writers(spark, tmp_path, writers, batch_rows):
    df = spark.createDataFrame([("k", ["a"]), ("k", ["c"]), ("k", ["b"]), ("l", ["d"])], "key string, value array<string>")
    folder = tmp_path / "kv"
    kv.kv_write(df, lambda: FileKeyValueClient(str(folder)), writers=writers, batch_rows=batch_rows)
    lines = [json.loads(line) for p in folder.iterdir() for line in p.read_text().splitlines()]
    assert sorted((x["key"], x["value"]) for x in lines if x["op"] == "put") == [("k", ["c"]), ("l", ["d"])]


# ---------------------------------------------------------------- messages


def field(schema, name):
    return next(f for f in schema["fields"] if f["name"] == name)


def test_message_schema(spark):
    schema = spark.createDataFrame(
        [],
        "field1 bigint, field2 string, field3 int, t tinyint, "
        "field4 struct<nested_field1:bigint,nested_field2:string,nested_field3:int>, a array<bigint>, "
        "m map<string,bigint>, u array<struct<x:int>>",
    ).schema
    out = message.message_schema(schema, "my_table", private=["field3"])
    assert out["name"] == "my_table" and len(out["fields"]) == 8
    assert out["doc"] == schema.simpleString()
    assert field(out, "field1")["type"] == ["null", "long"] and field(out, "field1")["default"] is None
    assert field(out, "field3")["type"] == ["null", "string"]
    assert field(out, "t")["type"] == ["null", "int"]
    nested = field(out, "field4")["type"][1]
    assert nested["name"] == "field4"
    assert field(nested, "nested_field3")["type"][1] == "int"
    assert field(out, "a")["type"][1] == {"type": "array", "items": ["null", "long"]}
    assert field(out, "m")["type"][1] == {"type": "map", "values": ["null", "long"]}
    assert field(out, "u")["type"][1]["items"][1]["name"].startswith("record_")
    with pytest.raises(ValueError):
        message.message_schema(T.StructType([T.StructField("d", T.DateType())]), "x")


def test_java_hash():
    assert message._java_hash("abc") == 96354
    assert message._java_hash("struct<field1:string,field2:string>") == sum(
        ord(c) * 31 ** (34 - i) for i, c in enumerate("struct<field1:string,field2:string>")
    ) % 2**32 - (2**32 if sum(ord(c) * 31 ** (34 - i) for i, c in enumerate("struct<field1:string,field2:string>")) % 2**32 >= 2**31 else 0)


def test_messages_flatten_arrays_and_drop_nulls(spark):
    df = spark.createDataFrame(
        [(1, [[1, None], None, [2]], {"a": None, "b": 1}, None, [("x", [[3], [None, 4]])])],
        "id int, n array<array<int>>, m map<string,int>, s struct<p:int>, d array<struct<k:string,v:array<array<int>>>>",
    )
    row = message.message_encode(df, "id").collect()[0]
    assert row.key == "1"
    assert json.loads(row.value) == {"id": 1, "n": [1, 2], "m": {"b": 1}, "s": None, "d": [{"k": "x", "v": [3, 4]}]}


def read_long(data, at):
    shift = number = 0
    while True:
        byte = data[at]
        at += 1
        number |= (byte & 0x7F) << shift
        shift += 7
        if not byte & 0x80:
            return (number >> 1) ^ -(number & 1), at


def test_binary_messages(spark):
    df = spark.createDataFrame(
        [(-70000, "é", True, 1.5, ["a", None, "b"], {"k": 5}, None)],
        "id bigint, s string, b boolean, d double, l array<string>, m map<string,int>, z struct<x:int>",
    )
    row = message.message_encode_avro(df, "id", "t").collect()[0]
    data, at = bytes(row.value), 0
    branch, at = read_long(data, at)
    number, at = read_long(data, at)
    assert (row.key, branch, number) == ("-70000", 1, -70000)
    assert data[at : at + 4] == b"\x02\x04\xc3\xa9"
    at += 4
    assert data[at : at + 2] == b"\x02\x01"
    import struct

    assert data[at + 2 : at + 11] == b"\x02" + struct.pack("<d", 1.5)
    at += 11
    assert data[at:] == b"\x02" + b"\x04\x02\x02a\x02\x02b\x00" + b"\x02" + b"\x02\x02k\x02\x0a\x00" + b"\x00"


def test_message_write(spark, tmp_path):
    folder = str(tmp_path / "topic")
    df = spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit("{}").alias("value"))
    message.message_write(df, message.topic_name("db", "t"), lambda: FileKeyValueClient(folder), writers=2, batch_rows=3)
    lines = [json.loads(line) for p in (tmp_path / "topic").iterdir() for line in p.read_text().splitlines()]
    assert len(lines) == 20 and {x["topic"] for x in lines} == {"db_t"}


# ---------------------------------------------------------------- files


def test_writers_count_what_they_write(spark, tmp_path):
    """Once over the rows: a second scan would count in the accumulator again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(30).selectExpr("CAST(id AS string) AS key", "IF(id % 3 = 0, NULL, 'v') AS value").mapInPandas(seen, "key string, value string")
    assert files.export_csv(rows, str(tmp_path / "c"), writers=2) == {"success": 30, "failed": 0} and read.value == 30
    assert files.export_json_lines(rows, str(tmp_path / "j")) == {"success": 30, "failed": 0} and read.value == 60
    sent = message.message_write(rows, "t", lambda: FileKeyValueClient(str(tmp_path / "m")), writers=3)
    assert sent == {"success": 20, "failed": 10} and read.value == 90
    assert files.export_csv(rows.limit(0), str(tmp_path / "e")) == {"success": 0, "failed": 0}


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b" ', None, [1])], "id int, s string, n string, l array<int>")
    files.export_csv(df, str(tmp_path / "out"), codec="none", writers=1)
    (name,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part") and p.stat().st_size]
    assert name.read_text() == '"id"\t"s"\t"n"\t"l"\n"1"\t"a ""b"""\t""\t"[1]"\n'
    with pytest.raises(ValueError):
        files.export_csv(df, str(tmp_path / "x"), delimiter="ab")
    with pytest.raises(ValueError):
        files.export_csv(df, str(tmp_path / "x"), codec="zip")


def test_json_lines_may_start_with_a_nested_column(spark):
    df = spark.createDataFrame([([[1], [None, 2]], "x")], "n array<array<int>>, s string")
    (row,) = files.json_lines_encode(df, private=["s"]).collect()
    line = json.loads(row.value)
    assert line["n"] == [1, 2] and len(line["s"]) == 32


def test_upload(spark, tmp_path):
    remote = tmp_path / "remote"
    sent = files.upload_files(
        spark.range(10),
        str(tmp_path / "scratch"),
        lambda: FolderUploader(str(remote)),
        files.remote_prefix("db", "t"),
        datetime(2024, 5, 1, 10, 11, 12, 345000),
        kind="json",
        writers=2,
    )
    names = sorted(r.remote for r in sent.collect())
    assert names == ["db-t-20240501101112345-00000-0.json.gz", "db-t-20240501101112345-00001-0.json.gz"]
    lines = [x for n in names for x in gzip.open(remote / n, "rt").read().splitlines()]
    assert sorted(json.loads(x)["id"] for x in lines) == list(range(10))
    assert not (tmp_path / "scratch").exists()


def test_upload_of_several_files_per_task(spark, tmp_path):
    remote = tmp_path / "remote"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        sent = files.upload_files(
            spark.range(100), str(tmp_path / "scratch"), lambda: FolderUploader(str(remote)), "p", datetime(2024, 5, 1), "json", writers=2
        )
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    names = [r.remote for r in sent.collect()]
    assert len(names) == len(set(names)) > 2
    assert sorted(json.loads(x)["id"] for n in names for x in gzip.open(remote / n, "rt").read().splitlines()) == list(range(100))


# ---------------------------------------------------------------- warehouse


def test_warehouse_schema(spark):
    schema = spark.createDataFrame(
        [],
        "i int, l bigint, t tinyint, f float, d double, b boolean, s string, m map<string,int>, a array<int>, "
        "aa array<array<int>>, am array<map<string,int>>, r struct<x:int,y:array<string>>, ar array<struct<z:boolean>>",
    ).schema
    out = {c["name"]: (c["type"], c["mode"]) for c in warehouse.warehouse_schema(schema)}
    assert list(out)[0] == "_USED_HCAT_FILTER" and out["_USED_HCAT_FILTER"] == ("STRING", "NULLABLE")
    assert out["i"] == out["l"] == out["t"] == ("INTEGER", "NULLABLE")
    assert out["f"] == out["d"] == ("FLOAT", "NULLABLE")
    assert out["b"] == ("BOOLEAN", "NULLABLE") and out["s"] == out["m"] == ("STRING", "NULLABLE")
    assert out["a"] == ("INTEGER", "REPEATED") and out["aa"] == out["am"] == ("STRING", "REPEATED")
    assert out["r"] == ("RECORD", "NULLABLE") and out["ar"] == ("RECORD", "REPEATED")
    record = next(c for c in warehouse.warehouse_schema(schema) if c["name"] == "r")
    assert record["fields"][1] == {"name": "y", "type": "STRING", "mode": "REPEATED"}


def test_warehouse_lines(spark):
    df = spark.createDataFrame(
        [(1, None, {"a": 1}, [[1], [2, 3]], ({"k": 2},))],
        "id int, n string, m map<string,int>, aa array<array<int>>, r struct<m:map<string,int>>",
    )
    line = json.loads(warehouse.warehouse_encode(df, "p = 'v'").collect()[0].value)
    assert line == {
        "_USED_HCAT_FILTER": "p = 'v'",
        "id": 1,
        "m": '{"a":1}',
        "aa": ["[1]", "[2,3]"],
        "r": {"m": '{"k":2}'},
    }


def test_warehouse_targets():
    assert warehouse.warehouse_target("t", {"shop": "EC01", "app": "X", "year": "2014", "month_id": "201410"}) == "t_x_ec01$20141001"
    assert warehouse.warehouse_target("t", {"year": "2014", "date_id": "20141003"}) == "t$20141003"
    assert warehouse.warehouse_target("t", {}) == "t"


class RecordingWarehouse:
    def __init__(self, fails=False):
        self.calls, self.lines, self.fails = [], [], fails

    def drop_partition(self, target):
        self.calls.append("drop")

    def create_table(self, target, schema):
        self.calls.append("create")

    def load(self, target, location):
        self.calls.append("load")
        if self.fails:
            raise OSError("load failed")
        import pathlib

        for path in pathlib.Path(location).glob("*.gz"):
            self.lines += gzip.open(path, "rt").read().splitlines()

    def remove_files(self, location):
        self.calls.append("remove")


def test_warehouse_write(spark, tmp_path):
    client = RecordingWarehouse()
    counts = warehouse.warehouse_write(spark.range(12), str(tmp_path / "w"), "t$20240501", client, writers=2)
    assert counts == {"success": 12, "failed": 0}
    assert client.calls == ["drop", "create", "load", "remove"]
    assert sorted(json.loads(x)["id"] for x in client.lines) == list(range(12))
    failing = RecordingWarehouse(fails=True)
    with pytest.raises(OSError):
        warehouse.warehouse_write(spark.range(2), str(tmp_path / "v"), "t", failing)
    assert failing.calls == ["drop", "create", "load", "drop", "remove"]
    unwritten = RecordingWarehouse()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        warehouse.warehouse_write(spark.range(2).selectExpr("1 div id AS x"), str(tmp_path / "u"), "t", unwritten)
    assert unwritten.calls == ["remove"]


def test_uploads_are_spread_without_a_number_of_writers(spark):
    names = spark.range(200).select(F.concat(F.lit("file:/x/part-"), "id").alias("source"), F.lit("r").alias("remote"))
    spread = files._spread(names, None)
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert files._spread(names, 3).rdd.getNumPartitions() == 3


def test_a_failed_database_export_leaves_no_files(spark):
    def write(rows, url, name):
        raise OSError("connection lost")

    def staged():
        return sorted(p.name for p in pathlib.Path(shared_dir(spark)).glob("jdbc-*"))

    before, done = staged(), []
    with pytest.raises(OSError):
        jdbc.jdbc_export(
            spark.range(5), "jdbc:derby:memory:none", "db", "t", done.extend, lambda t: bool(done), None, write=write
        )
    assert staged() == before
    assert done[-1] == "DROP TABLE tmp_db_t"
