"""Avro: columnar encoding against one value at a time, and container files in splits and two phases."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewforge.functions.avro import Decoder, encode_rows, varints
from viewforge.sources import avro

DDL = (
    "id long, name string, ok boolean, f float, d double, raw binary, day date, at timestamp, small int, "
    "tags array<string>, nested array<array<int>>, props map<string,struct<a:int,b:array<string>>>, who struct<x:long,y:string>"
)


def drawn(n, seed=1):
    draw = random.Random(seed)
    some = lambda value: None if draw.random() < 0.2 else value
    text = lambda: "".join(draw.choice("aé中 \n") for _ in range(draw.choice([0, 1, 3, 70])))
    rows = []
    for _ in range(n):
        props = {text(): some({"a": some(draw.randint(-9, 9)), "b": some([some(text())])}) for _ in range(draw.randint(0, 3))}
        rows.append(
            (
                some(draw.choice([0, -1, 63, 64, -64, -65, 2**62, -(2**63), 2**63 - 1])),
                some(text()),
                some(draw.random() < 0.5),
                some(0.5),
                some(draw.random()),
                some(text().encode()),
                some(datetime.date(1960 + draw.randint(0, 90), 1, 2)),
                some(datetime.datetime(1969, 12, 31, 23, 59, 59, draw.randint(0, 999_999))),
                some(draw.randint(-(2**31), 2**31 - 1)),
                some([some(text()) for _ in range(draw.randint(0, 3))]),
                some([some([some(1), 2]) for _ in range(draw.randint(0, 2))]),
                some(props),
                some((some(3), some(text()))),
            )
        )
    return rows


def same(a, b):
    key = lambda r: str(r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_numbers_of_variable_length():
    values = np.array([0, -1, 1, 63, 64, -64, -65, 300, 2**62, -(2**63), 2**63 - 1])
    parts = varints(values)
    assert parts.data[:3].tolist() == [0, 1, 2] and parts.lengths.tolist()[3:7] == [1, 2, 1, 2]
    decoder = Decoder(parts.data.tobytes())
    assert [decoder.long() for _ in values] == values.tolist() and decoder.at == len(parts.data)


def test_slices_of_columns_are_encoded_as_their_rows(spark):
    frame = spark.createDataFrame(drawn(60), DDL)
    table = frame.toArrow().combine_chunks().to_batches()[0]
    schema = avro.avro_schema(frame.schema)
    whole = encode_rows(table.columns, schema).values().to_pylist()
    part = encode_rows(table.slice(13, 20).columns, schema).values().to_pylist()
    assert part == whole[13:33] and encode_rows(table.slice(5, 0).columns, schema).values().to_pylist() == []
    read = [Decoder(row).value(schema) for row in whole]
    assert read == [{k: dict(v) if k == "props" and v is not None else v for k, v in r.items()} for r in table.to_pylist()]


@pytest.mark.parametrize("codec", ["deflate", "null"])
def test_round_trip(spark, tmp_path, codec):
    avro.register(spark)
    frame, path = spark.createDataFrame(drawn(500), DDL).repartition(3), str(tmp_path / "t")
    frame.write.format(avro.FORMAT).option("codec", codec).mode("append").save(path)
    back = spark.read.format(avro.FORMAT).load(path)
    assert back.schema.simpleString() == frame.schema.simpleString()
    same(back.collect(), frame.collect())
    frame.limit(10).write.format(avro.FORMAT).mode("overwrite").save(path)
    assert spark.read.format(avro.FORMAT).load(path).count() == 10
    assert not [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    avro.register(spark)
    path = str(tmp_path / "t")
    frame = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    frame.coalesce(1).write.format(avro.FORMAT).option("codec", "null").mode("append").save(path)
    [(file, size)] = avro.data_files(path)
    reader = spark.read.format(avro.FORMAT).option("splitBytes", "1000000")
    for at in (path, file):
        back = reader.load(at).withColumn("task", F.spark_partition_id())
        figures = back.agg(F.count("id"), F.countDistinct("id"), F.sum("id"), F.countDistinct("task")).first()
        assert figures[:3] == (200_000, 200_000, sum(range(200_000))) and figures[3] > 10
    # Every block belongs to exactly one split, wherever splits begin.
    system, name = avro.open_uri(file)
    with system.open_input_file(name) as stream:
        header = avro.read_header(stream)
        whole = [n for n, _ in avro.blocks(stream, header, 0, size)]
        for step in (17, 262_144, 262_500, size):
            step = max(step, size // 300)
            parts = [n for s in range(0, size, step) for n, _ in avro.blocks(stream, header, s, min(s + step, size))]
            assert parts == whole and sum(whole) == 200_000
    assert reader.schema("id long, text string").load(str(tmp_path / "empty")).count() == 0


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    avro.register(spark)
    path = str(tmp_path / "t")
    spark.range(5).write.format(avro.FORMAT).mode("append").save(path)
    before = avro.data_files(path)
    bad = spark.range(0, 100, numPartitions=4).select(F.when(F.col("id") > 80, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        bad.write.format(avro.FORMAT).mode("overwrite").save(path)
    assert spark.read.format(avro.FORMAT).load(path).count() == 5
    assert avro.data_files(path) == before  # tasks that still ran may leave a hidden folder


def test_a_damaged_file_is_refused(tmp_path):
    (tmp_path / "x.avro").write_bytes(b"Obj\x01" + b"\x00" * 40)
    with pytest.raises(Exception):
        avro.AvroContainer({"path": str(tmp_path / "x.avro")}).schema()
    assert isinstance(avro.avro_schema(avro.T.StructType()), dict) and pa.__version__


def test_partitions_are_folders_and_replaced_one_by_one(spark, tmp_path):
    from viewforge.model import Avro, Field, ViewDef
    from viewforge.sources.formats import read_view, write_view

    view = ViewDef("Sales", [Field("n", "int")], partitions=[Field("month", "int"), Field("kind", "string")], storage=Avro("x.avsc"))
    rows = spark.createDataFrame([(1, 5, "a/b"), (2, 5, None), (3, 6, "é %")], "n int, month int, kind string")
    path = str(tmp_path / "sales")
    write_view(rows, view, path)
    same(read_view(spark, view, path).collect(), rows.collect())
    write_view(rows.where("n = 3").withColumn("n", F.lit(30)), view, path, dynamic=True)
    same(read_view(spark, view, path).collect(), [(1, 5, "a/b"), (2, 5, None), (30, 6, "é %")])
    write_view(rows.where("n = 1"), view, path)
    same(read_view(spark, view, path).collect(), [(1, 5, "a/b")])
