"""Declarations, storage formats, partition writes and copying."""

from __future__ import annotations

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from viewforge.model import (
    CREATED_AT,
    CREATED_BY,
    ID,
    MONTHLY,
    OCCURRED_AT,
    Avro,
    Csv,
    Field,
    InOutputFormat,
    Json,
    Orc,
    Parquet,
    RecordColumnarFile,
    RegexText,
    SequenceFile,
    TextFile,
    ViewDef,
    create_table_statement,
    declaration_text,
    escape_path_value,
    snake_case,
)
from viewforge.operators.views import (
    conform,
    insert_dynamically_into,
    insert_into,
    read_suffix_table,
    select_all,
    select_all_ordered,
    write_suffix_tables,
)
from viewforge.plans.transform import scoped_settings
from viewforge.sources.files import copy_plan, copy_tasks, distributed_copy, distributed_copy_to_view, ingest_files, read_tsv
from viewforge.sources.formats import read_view, write_view

PRODUCT = ViewDef(
    "Product",
    [CREATED_BY, CREATED_AT, Field("brandId", "string"), Field("name", "string", privacy=True), OCCURRED_AT, ID],
    package="test.views",
    partitions=MONTHLY,
    suffixes=[Field("shopCode", "string")],
)


def test_names():
    assert [snake_case(n) for n in ("shopName", "ShopName", "aURL", "x")] == ["shop_name", "shop_name", "a_u_r_l", "x"]
    assert PRODUCT.table_name(["EC01"]) == "dev_test_views.product_ec01"
    assert PRODUCT.path("s3a://bucket/warehouse/", ["EC01"]) == "s3a://bucket/warehouse/dev_test_views/product_ec01"
    assert Field("someName", "int", override="other_name").column == "other_name"


def test_column_order_and_privacy(spark):
    assert PRODUCT.columns == ["id", "occurred_at", "brand_id", "name", "created_at", "created_by"]
    assert PRODUCT.schema.names[-3:] == ["year", "month", "month_id"]
    assert PRODUCT.privacy_columns == ["name"]
    assert PRODUCT.schema["name"].metadata["privacy"] is True


def test_partition_paths():
    params = {"year": "2014", "month_id": "201410", "month": "10"}
    assert PRODUCT.partition_path(params) == "/year=2014/month=10/month_id=201410"
    assert escape_path_value("a/b=c") == "a%2Fb%3Dc"
    assert escape_path_value(None) == "__HIVE_DEFAULT_PARTITION__"


@pytest.mark.parametrize(
    "storage, clause",
    [
        (Parquet(), "STORED AS PARQUET"),
        (Orc(), "STORED AS ORC"),
        (RecordColumnarFile(), "STORED AS RCFILE"),
        (Avro("a.avsc"), "STORED AS AVRO"),
        (Json(), "JsonSerDe"),
        (Csv(";", "'", "\\"), "'separatorChar'=';'"),
        (RegexText("(a)"), "'input.regex'='(a)'"),
        (SequenceFile(), "STORED AS SEQUENCEFILE"),
        (TextFile(), "STORED AS TEXTFILE"),
        (InOutputFormat("in.Class", "out.Class", "serde.Class"), "STORED AS INPUTFORMAT 'in.Class' OUTPUTFORMAT 'out.Class'"),
    ],
)
def test_declarations(spark, storage, clause):
    text = create_table_statement(PRODUCT.with_storage(storage), "/wh", ["ec01"])
    assert clause in text
    assert text.startswith("CREATE EXTERNAL TABLE IF NOT EXISTS dev_test_views.product_ec01")
    assert "PARTITIONED BY (`year` string, `month` string, `month_id` string)" in text
    assert text.rstrip().endswith("LOCATION '/wh/dev_test_views/product_ec01'") or "TBLPROPERTIES" in text
    assert ("`brand_id` string" in text) != isinstance(storage, Avro)


def test_avro_schema_path_does_not_change_a_declaration(spark):
    a, b = (declaration_text(PRODUCT.with_storage(Avro(p))) for p in ("x/a.avsc", "y/b.avsc"))
    assert a == b
    assert declaration_text(PRODUCT) != declaration_text(replace(PRODUCT, comment="new"))


EDGE = ViewDef(
    "EdgeCases",
    [
        Field("aMap", "map<string,int>"),
        Field("anArray", "array<int>"),
        Field("structs", "array<struct<a:string,b:string>>"),
        Field("aStructure", "struct<a_field:int,b_field:string>"),
        Field("text", "string"),
        Field("flag", "boolean"),
    ],
)
EDGE_ROWS = [
    ({"k": 1, "l": 2}, [1, 2, 3], [("x", "y"), ("z", "w")], (7, "s"), "plain", True),
    ({}, [], [], (None, "t"), "", False),
    (None, None, None, None, None, None),
]


def texts(df):
    """Rows as JSON with sorted keys: the order of map entries does not count."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()
    return sorted(json.dumps(json.loads(r.j), sort_keys=True) for r in rows)


@pytest.mark.parametrize(
    "storage", [Parquet(), Orc(), Json(), TextFile(), TextFile("|", ",", ":", "\n"), SequenceFile()], ids=str
)
def test_nested_round_trip(spark, tmp_path, storage):
    df = spark.createDataFrame(EDGE_ROWS, EDGE.schema)
    view = EDGE.with_storage(storage)
    path = str(tmp_path / "t")
    write_view(df, view, path)
    assert texts(read_view(spark, view, path)) == texts(df)


def test_text_layout(spark, tmp_path):
    view = ViewDef(
        "T",
        [Field("a", "int"), Field("m", "map<string,string>"), Field("l", "array<string>"), Field("s", "array<struct<x:int,y:int>>")],
        storage=TextFile("\t", ",", ":"),
    )
    df = spark.createDataFrame([(1, {"a": "b"}, ["x", "y"], [(1, 2), (3, None)])], view.schema)
    write_view(df, view, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1\ta:b\tx,y\t1:2,3:\\N"]


DEEP = ViewDef(
    "Deep",
    [
        Field("lists", "array<array<int>>"),
        Field("cubes", "array<array<array<string>>>"),
        Field("of_lists", "map<string,array<int>>"),
        Field("of_maps", "map<string,map<string,struct<x:int,l:array<string>>>>"),
        Field("parts", "struct<a:struct<b:int,c:array<int>>,d:string>"),
    ],
)
DEEP_ROWS = [
    ([[1, 2], [3]], [[["a", "b"], ["c"]], [["d"]]], {"k": [1, 2], "l": [3]}, {"m": {"n": (1, ["p", "q"]), "o": (None, ["r"])}}, ((1, [2, 3]), "e")),
    ([[1, None], None], [[["x"]]], {"k": None}, {"m": None}, ((None, None), None)),
    (None, None, None, None, None),
]


@pytest.mark.parametrize("storage", [TextFile(), TextFile("|", ",", ":"), TextFile("\t", ",", ":", escape="\\"), TextFile("\x04", "\x05", "\x06")], ids=str)
def test_every_depth_has_a_terminator_of_its_own(spark, tmp_path, storage):
    df = spark.createDataFrame(DEEP_ROWS, DEEP.schema)
    view = DEEP.with_storage(storage)
    write_view(df, view, str(tmp_path / "t"))
    assert texts(read_view(spark, view, str(tmp_path / "t"))) == texts(df)


def test_deep_layout(spark, tmp_path):
    view = ViewDef("T", [Field("l", "array<array<int>>"), Field("m", "map<string,array<int>>")], storage=TextFile("\t", ",", ":"))
    write_view(spark.createDataFrame([([[1, 2], [3]], {"k": [4, 5]})], view.schema), view, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1:2,3\tk:4\x045"]


def test_escaped_terminators_come_back(spark, tmp_path):
    signs = ["|", ",", ":", "\n", "\\", "\\n", "n", "\x04", "\\N", "a|b\\|c\n\\\\", "", "\\\\\n|,:"]
    fields = [Field("id", "int"), Field("s", "string"), Field("l", "array<string>"), Field("m", "map<string,string>")]
    view = ViewDef("T", fields, storage=TextFile("|", ",", ":", escape="\\"))
    rows = [(i, s, [s, "x", s], {f"k{s}": s}) for i, s in enumerate(signs)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, view.schema)
    write_view(df, view, str(tmp_path / "t"))
    assert texts(read_view(spark, view, str(tmp_path / "t"))) == texts(df)
    assert "ESCAPED BY" in create_table_statement(view, "/w")
    with pytest.raises(ValueError, match="one character"):
        TextFile("||", escape="\\")


def test_unreadable_cells_become_null(spark, tmp_path):
    (tmp_path / "f.txt").write_text("x\tword\n5\t\\N\n7\n")
    view = ViewDef("T", [Field("n", "int"), Field("s", "string")], storage=TextFile())
    rows = sorted(map(str, read_view(spark, view, str(tmp_path)).collect()))
    assert rows == sorted(["Row(n=None, s='word')", "Row(n=5, s=None)", "Row(n=7, s=None)"])


def test_regex_text_needs_the_whole_line(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a-1\na-1x\nb-22\n")
    view = ViewDef("T", [Field("l", "string"), Field("n", "int")], storage=RegexText(r"([a-z])-(\d+)"))
    assert sorted(map(tuple, read_view(spark, view, str(tmp_path)).collect()), key=str) == [("a", 1), ("b", 22), (None, None)]


def test_external_views_are_read_only(spark, tmp_path):
    with pytest.raises(ValueError, match="external"):
        write_view(spark.range(1), ViewDef("E", [Field("id", "bigint")], external=True), str(tmp_path / "e"))


def test_formats_of_hive_tables_need_hive(spark, tmp_path):
    view = ViewDef("R", [Field("id", "bigint")], storage=RecordColumnarFile())
    with pytest.raises(RuntimeError, match="Hive"):
        write_view(spark.range(1), view, str(tmp_path / "r"))


SALES = ViewDef("Sales", [Field("n", "int")], partitions=[Field("year", "string"), Field("month", "string")])


def sales(spark, *rows):
    return spark.createDataFrame(list(rows), "n int, year string, month string")


def content(spark, path):
    return sorted(map(tuple, read_view(spark, SALES, path).collect()))


def test_static_overwrite_touches_one_partition(spark, tmp_path):
    path = str(tmp_path / "sales")
    write_view(sales(spark, (1, "2014", "01"), (2, "2014", "02")), SALES, path)
    insert_into(sales(spark, (9, "x", "y")), SALES, path, {"year": "2014", "month": "02"})
    assert content(spark, path) == [(1, "2014", "01"), (9, "2014", "02")]
    insert_into(sales(spark).limit(0), SALES, path, {"year": "2014", "month": "02"})
    assert content(spark, path) == [(1, "2014", "01")]
    with pytest.raises(ValueError):
        insert_into(sales(spark, (1, "a", "b")), SALES, path, {"year": "2014"})


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "sales")
    write_view(sales(spark, (1, "2014", "01"), (2, "2014", "02")), SALES, path)
    insert_dynamically_into(sales(spark, (7, "2014", "02"), (8, "2015", "01")), SALES, path)
    assert content(spark, path) == [(1, "2014", "01"), (7, "2014", "02"), (8, "2015", "01")]


def test_a_whole_overwrite_does_not_depend_on_the_session(spark, tmp_path):
    path = str(tmp_path / "sales")
    with scoped_settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        insert_into(sales(spark, (1, "2014", "01")), SALES, path)
        insert_into(sales(spark, (2, "2014", "02")), SALES, path)
    assert content(spark, path) == [(2, "2014", "02")]


def test_reading_partitions(spark, tmp_path):
    path = str(tmp_path / "sales")
    write_view(sales(spark, (10, "2014", "01"), (9, "2014", "01"), (None, "2014", "01"), (1, "2015", "1")), SALES, path)
    assert select_all(spark, SALES, path, {"year": "2015", "month": "01"}).count() == 0
    ordered = select_all_ordered(spark, SALES, path, {"year": "2014"}, "n").collect()
    assert [r.n for r in ordered] == [None, 10, 9]
    with pytest.raises(ValueError):
        select_all(spark, SALES, path, {"day": "01"})


def test_partition_reads_are_pruned(spark, tmp_path):
    path = str(tmp_path / "sales")
    write_view(sales(spark, (1, "2014", "01"), (2, "2015", "02")), SALES, path)
    plan = select_all(spark, SALES, path, {"year": "2015"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_suffix_tables(spark, tmp_path):
    view = ViewDef("Brand", [Field("name", "string")], package="shop", suffixes=[Field("shopCode", "string")])
    df = spark.createDataFrame([("a", "EC01"), ("b", "EC02"), ("c", "EC01")], "name string, shop_code string")
    tables = {r.table_name: r.shop_code for r in write_suffix_tables(df, view, str(tmp_path)).collect()}
    assert tables == {"dev_shop.brand_ec01": "EC01", "dev_shop.brand_ec02": "EC02"}
    one = read_suffix_table(spark, view, str(tmp_path), ["EC01"])
    assert one.columns == ["name"] and sorted(r.name for r in one.collect()) == ["a", "c"]


def test_conform_casts(spark):
    view = ViewDef("V", [Field("someNumber", "int"), ID])
    df = spark.createDataFrame([("5", 3, "extra")], "some_number string, id long, other string")
    out = conform(df, view)
    assert out.columns == ["id", "some_number"] and out.collect() == [("3", 5)]


def test_ingest_recurses_and_skips_hidden_folders(spark, tmp_path):
    for folder, text in (("a", "1\tx\n"), ("a/b", "2\t\\N\n"), (".hidden", "3\tz\n")):
        os.makedirs(tmp_path / "in" / folder, exist_ok=True)
        (tmp_path / "in" / folder / "f.txt").write_text(text)
    view = ViewDef("V", [Field("n", "int"), Field("s", "string")])
    rows = ingest_files(spark, str(tmp_path / "in"), view, str(tmp_path / "out")).collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, None)]


def folder(path, **files):
    os.makedirs(path, exist_ok=True)
    for name, text in files.items():
        (path / name).write_text(text)


def read_all(path):
    return {
        str(p.relative_to(path)): p.read_text()
        for p in path.rglob("*")
        if p.is_file() and not p.name.startswith(".")
    }


def test_copying(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    folder(source, a="1", b="22")
    folder(source / "sub", c="333")
    rows = distributed_copy(spark, [str(source)], str(target), max_tasks=3).collect()
    assert {r.action for r in rows} == {"copy"} and sum(r.bytes for r in rows) == 6
    assert read_all(target) == {"a": "1", "b": "22", "sub/c": "333"}

    folder(source, a="changed")
    folder(target, old="gone")
    kept = {r.target.rsplit("/", 1)[1]: r.action for r in copy_plan(spark, [str(source)], str(target)).collect()}
    assert kept == {"a": "skip", "b": "skip", "c": "skip"}
    rows = distributed_copy(spark, [str(source)], str(target), update=True, delete_missing=True, max_tasks=3).collect()
    assert {r.target.rsplit("/", 1)[1]: r.action for r in rows} == {"a": "copy", "b": "skip", "c": "skip", "old": "delete"}
    assert read_all(target) == {"a": "changed", "b": "22", "sub/c": "333"}
    rows = distributed_copy(spark, [str(source)], str(target), overwrite=True, max_tasks=3).collect()
    assert all(r.action == "copy" for r in rows)


def test_single_files_patterns_and_hidden_names_are_copied(spark, tmp_path):
    source = tmp_path / "s"
    folder(source, a="1", _SUCCESS="", **{".h": "22", "b.file": "3", "c.file": "4"})
    folder(source / "_sub" / "deeper", d="5")
    distributed_copy(spark, [str(source)], str(tmp_path / "all"), max_tasks=3)
    assert sorted(str(p.relative_to(tmp_path / "all")) for p in (tmp_path / "all").rglob("*") if p.is_file()) == sorted(
        [".h", "_SUCCESS", "_sub/deeper/d", "a", "b.file", "c.file"]
    )
    distributed_copy(spark, [str(source / "a")], str(tmp_path / "one"))
    distributed_copy(spark, [str(source / "*.file")], str(tmp_path / "some"))
    distributed_copy(spark, [str(source / "*")], str(tmp_path / "again"))
    distributed_copy_to_view(spark, str(source / "a"), str(tmp_path / "wh" / "view"))
    assert read_all(tmp_path / "one") == {"a": "1"} and read_all(tmp_path / "some") == {"b.file": "3", "c.file": "4"}
    assert read_all(tmp_path / "again")["_sub/deeper/d"] == "5" and read_all(tmp_path / "wh") == {"a": "1"}
    with pytest.raises(FileNotFoundError):
        distributed_copy(spark, [str(tmp_path / "none")], str(tmp_path / "t"))


def test_several_files_for_one_target_are_refused(spark, tmp_path):
    folder(tmp_path / "x", a="1")
    folder(tmp_path / "y", a="2")
    with pytest.raises(ValueError, match="one target: a"):
        copy_plan(spark, [str(tmp_path / "x"), str(tmp_path / "y")], str(tmp_path / "t"))


def test_copies_are_split_by_bytes(spark):
    sizes = [(f"/s/{i:03}", f"/t/{i:03}", "copy", 90 << 30 if i == 37 else (10 << 30) // 99) for i in range(100)]
    plan = spark.createDataFrame(sizes, "source string, target string, action string, length long").repartition(7)
    tasks = {r.target: r.task for r in copy_tasks(plan, 20).collect()}
    assert len(tasks) == 100 and set(tasks.values()) <= set(range(20))
    assert [t for t in tasks.values()].count(tasks["/t/037"]) == 1
    even = plan.withColumn("length", F.lit(1 << 30))
    counts = copy_tasks(even, 20).groupBy("task").count().collect()
    assert len(counts) == 20 and all(4 <= r["count"] <= 6 for r in counts)


def test_stage_files_have_no_quotes_and_a_declared_format(spark, tmp_path):
    folder(tmp_path / "in" / "deep", f='1\t"x\n2\ty"z"\n')
    view = ViewDef("V", [Field("n", "int"), Field("s", "string")])
    want = [(1, '"x'), (2, 'y"z"')]
    assert sorted(map(tuple, read_tsv(spark, view, str(tmp_path / "in" / "deep")).collect())) == want
    assert sorted(map(tuple, ingest_files(spark, str(tmp_path / "in"), view, str(tmp_path / "out")).collect())) == want
    folder(tmp_path / "piped" / "deep", f="1|a,b\n")
    listed = ViewDef("L", [Field("n", "int"), Field("l", "array<string>")], storage=TextFile("|", ",", ":"))
    got = ingest_files(spark, str(tmp_path / "piped"), listed.with_storage(Parquet()), str(tmp_path / "lists"), source_view=listed)
    assert got.collect() == [(1, ["a", "b"])]


def test_copied_archives_stay_archives(spark, tmp_path):
    import gzip

    os.makedirs(tmp_path / "s")
    data = gzip.compress(b"text")
    (tmp_path / "s" / "f.gz").write_bytes(data)
    distributed_copy(spark, [str(tmp_path / "s")], str(tmp_path / "t"), max_tasks=1)
    assert (tmp_path / "t" / "f.gz").read_bytes() == data


def test_copying_beside_a_view(spark, tmp_path):
    folder(tmp_path / "incoming", a="1")
    distributed_copy_to_view(spark, str(tmp_path / "incoming"), str(tmp_path / "wh" / "view"))
    assert read_all(tmp_path / "wh") == {"incoming/a": "1"}
