"""Avro container files as a Spark data source: read in splits, written in two phases.

A file is a header, which ends with a random marker, and blocks, each followed by that
marker. A split reads the blocks whose preceding marker begins inside it, so the parts
of a large file are read by tasks of their own. Tasks write to a staging folder; only
when all are done are the files moved into place, and only then does an overwrite
remove the old ones.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from viewforge.functions.avro import Decoder, Parts, encode_rows, varints
from viewforge.sources.uris import open_uri

MAGIC, MARKER = b"Obj\x01", 16
#: Bytes of a block before compression, of a split, and of a search for a marker; rows of a batch.
BLOCK, SPLIT, SEARCH, BATCH_ROWS = 1 << 18, 64 << 20, 1 << 20, 4096
FORMAT = "avro_container"
_PRIMITIVE = {
    T.BooleanType: "boolean",
    T.ByteType: "int",
    T.ShortType: "int",
    T.IntegerType: "int",
    T.LongType: "long",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.StringType: "string",
    T.BinaryType: "bytes",
    T.DateType: {"type": "int", "logicalType": "date"},
    T.TimestampType: {"type": "long", "logicalType": "timestamp-micros"},
    T.TimestampNTZType: {"type": "long", "logicalType": "local-timestamp-micros"},
}
_LOGICAL = {
    "date": T.DateType(),
    "timestamp-millis": T.TimestampType(),
    "timestamp-micros": T.TimestampType(),
    "local-timestamp-millis": T.TimestampNTZType(),
    "local-timestamp-micros": T.TimestampNTZType(),
}
_SPARK = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}


def avro_schema(kind: T.DataType, name: str = "row") -> dict | list | str:
    """The schema of a type; everything may be null. Records are named by the way to them."""
    if isinstance(kind, T.StructType):
        fields = [{"name": f.name, "type": ["null", avro_schema(f.dataType, f"{name}_{i}")], "default": None} for i, f in enumerate(kind)]
        return {"type": "record", "name": name, "fields": fields}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", avro_schema(kind.elementType, f"{name}_item")]}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": ["null", avro_schema(kind.valueType, f"{name}_value")]}
    if type(kind) not in _PRIMITIVE:
        raise ValueError(f"no Avro type for {kind.simpleString()}")
    return _PRIMITIVE[type(kind)]


def spark_type(schema) -> T.DataType:
    """The type that values of a schema have in Spark; unions other than with null are refused."""
    if isinstance(schema, list):
        kinds = [s for s in schema if s != "null"]
        if len(kinds) != 1:
            raise ValueError(f"no type for the union {schema}")
        return spark_type(kinds[0])
    if isinstance(schema, str):
        return _SPARK[schema]
    kind = schema["type"]
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    return _LOGICAL.get(schema.get("logicalType"), _SPARK.get(kind)) or spark_type(kind)


@dataclass
class Header:
    schema: dict
    codec: str
    marker: bytes
    end: int


def read_header(stream) -> Header:
    size = SEARCH
    while True:
        stream.seek(0)
        raw = stream.read(size)
        try:
            decoder = Decoder(raw)
            if decoder.take(4) != MAGIC:
                raise TypeError("not an Avro container file")
            meta = decoder.value({"type": "map", "values": "bytes"})
            marker = decoder.take(MARKER)
        except ValueError:
            if len(raw) < size:
                raise
            size *= 4
            continue
        return Header(json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), marker, decoder.at)


def data_files(path: str) -> list[tuple[str, int]]:
    """Files of a table and their sizes, hidden ones left out; a single file is a table too."""
    system, root = open_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = [f for f in found if f.type == fs.FileType.File and not any(p[0] in "_." for p in f.path[len(root) :].strip("/").split("/"))]
    return [(f"{path.rstrip('/')}{f.path[len(root.rstrip('/')) :]}", f.size) for f in sorted(shown, key=lambda f: f.path)]


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


class AvroReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, split: int, folder: str | None) -> None:
        self.schema, self.path, self.split, self.folder = schema, path.rstrip("/"), split, folder

    def partitions(self) -> Sequence[Split]:
        return [Split(f, at, min(at + self.split, n)) for f, n in data_files(self.path) for at in range(0, n, self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        arrow = to_arrow_schema(self.schema)
        known = {self.folder: partition.file[len(self.path) :].rpartition("/")[0].strip("/")} if self.folder else {}
        system, path = open_uri(partition.file)
        with system.open_input_file(path) as stream:
            header, rows = read_header(stream), []
            for count, data in blocks(stream, header, partition.start, partition.end):
                decoder = Decoder(data)
                for _ in range(count):
                    rows.append(decoder.value(header.schema) | known)
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)


def blocks(stream, header: Header, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Row counts and bytes of the blocks whose preceding marker begins from ``start`` to ``end``."""
    at = header.end - MARKER if start <= header.end - MARKER else _next_marker(stream, header.marker, start, end)
    size = stream.size()
    while at is not None and at < end and at + MARKER < size:
        stream.seek(at + MARKER)
        decoder = Decoder(stream.read(20))
        count, length = decoder.long(), decoder.long()
        stream.seek(at + MARKER + decoder.at)
        data = stream.read(length)
        if len(data) < length or stream.read(MARKER) != header.marker:
            raise ValueError("a block does not end with the marker of its file")
        if header.codec == "deflate":
            data = zlib.decompress(data, -15)
        elif header.codec != "null":
            raise ValueError(f"no decoder for {header.codec}")
        yield count, data
        at += MARKER + decoder.at + length


def _next_marker(stream, marker: bytes, start: int, end: int) -> int | None:
    """Where the first marker begins from ``start`` to ``end``."""
    while start < end:
        stream.seek(start)
        found = stream.read(min(SEARCH, end - start) + MARKER - 1).find(marker)
        if found >= 0:
            return start + found
        start += SEARCH
    return None


@dataclass
class Written(WriterCommitMessage):
    """Folders and files that a task has staged."""

    files: list[tuple[str, str]]


class AvroWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, overwrite: bool, name: str, codec: str, folder: str | None, dynamic: bool) -> None:
        if codec not in ("null", "deflate"):
            raise ValueError(f"no encoder for {codec}")
        columns = [f for f in schema if f.name != folder]
        self.at = schema.names.index(folder) if folder else None
        self.schema, self.path, self.codec = avro_schema(T.StructType(columns), name), path.rstrip("/"), codec
        self.overwrite, self.dynamic, self.job = overwrite, dynamic, uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_uri(self.staging)
        system.create_dir(root, recursive=True)
        files, stream, marker = [], None, os.urandom(MARKER)
        for batch in iterator:
            for folder, part in self._by_folder(batch):
                if stream is None or folder != files[-1][0]:
                    if stream is not None:
                        stream.close()
                    files.append((folder, f"{uuid.uuid4().hex}.avro"))
                    stream = system.open_output_stream(f"{root}/{files[-1][1]}")
                    stream.write(self._header(marker))
                rows = encode_rows(part, self.schema)
                start, count = 0, len(rows.starts) - 1
                while start < count:
                    end = max(start + 1, int(np.searchsorted(rows.starts, rows.starts[start] + BLOCK, "right")) - 1)
                    stream.write(self._block(rows, start, min(end, count)) + marker)
                    start = min(end, count)
        if stream is not None:
            stream.close()
        return Written(files)

    def _by_folder(self, batch: pa.RecordBatch) -> Iterator[tuple[str, list[pa.Array]]]:
        """The columns of each run of rows of one folder; rows come sorted by it, so one file is open at a time."""
        if self.at is None:
            if batch.num_rows:
                yield "", batch.columns
            return
        folders = batch.column(self.at).to_pylist()
        bounds = [i for i in range(len(folders)) if not i or folders[i] != folders[i - 1]]
        for a, b in zip(bounds, [*bounds[1:], len(folders)], strict=True):
            yield folders[a], [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != self.at]

    def _header(self, marker: bytes) -> bytes:
        def text(value: bytes) -> bytes:
            return varints(np.array([len(value)])).data.tobytes() + value

        meta = {b"avro.schema": json.dumps(self.schema).encode(), b"avro.codec": self.codec.encode()}
        return MAGIC + varints(np.array([len(meta)])).data.tobytes() + b"".join(text(k) + text(v) for k, v in meta.items()) + b"\x00" + marker

    def _block(self, rows: Parts, start: int, end: int) -> bytes:
        data = rows.data[rows.starts[start] : rows.starts[end]].tobytes()
        if self.codec == "deflate":
            squeezed = zlib.compressobj(wbits=-15)
            data = squeezed.compress(data) + squeezed.flush()
        return varints(np.array([end - start, len(data)])).data.tobytes() + data

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_uri(self.path)
        staged = [f for m in messages if m is not None for f in m.files]
        old = data_files(self.path) if self.overwrite else []
        if self.dynamic:
            replaced = {folder for folder, _ in staged}
            old = [(f, n) for f, n in old if f[len(self.path) :].rpartition("/")[0].strip("/") in replaced]
        for number, (folder, name) in enumerate(staged):
            target = f"{root}/{folder}".rstrip("/")
            system.create_dir(target, recursive=True)
            system.move(f"{open_uri(self.staging)[1]}/{name}", f"{target}/part-{number:05d}-{self.job}.avro")
        for file, _ in old:
            system.delete_file(open_uri(file)[1])
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what repeated tasks have left."""
        system, folder = open_uri(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class AvroContainer(DataSource):
    """Options: ``path``, ``codec`` (``deflate`` or ``null``), ``recordName``, and ``splitBytes`` for reading.

    ``folderColumn`` names a column with the folder of each row below the path, such as
    ``month=05``; rows have to be sorted by it within a partition. With ``dynamic`` an
    overwrite replaces only the folders that rows came for. Python sources see no
    partition columns, so the caller turns them into folders and back.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        files = data_files(self.options["path"])
        if not files:
            raise ValueError(f"no Avro file under {self.options['path']}, and no schema was given")
        system, path = open_uri(files[0][0])
        with system.open_input_file(path) as stream:
            return spark_type(read_header(stream).schema)

    def reader(self, schema: T.StructType) -> AvroReader:
        return AvroReader(schema, self.options["path"], int(self.options.get("splitBytes", SPLIT)), self.options.get("folderColumn"))

    def writer(self, schema: T.StructType, overwrite: bool) -> AvroWriter:
        options = self.options
        dynamic = options.get("dynamic", "false").lower() == "true"
        name, codec = options.get("recordName", "row"), options.get("codec", "deflate")
        return AvroWriter(schema, options["path"], overwrite, name, codec, options.get("folderColumn"), dynamic)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AvroContainer)
