"""Reading and writing views in their declared storage format."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.functions.paths import path_value, value_of_path
from viewforge.model import (
    Avro,
    Csv,
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
)
from viewforge.session import remove_folder
from viewforge.sources import avro

NULL_TEXT = "\\N"


def conform(df: DataFrame, view: ViewDef) -> DataFrame:
    """Cast and order columns as the view declares them, partition columns last."""
    return df.select(
        *(
            F.col(f"`{f.column}`").cast(f.data_type).alias(f.column, metadata=f.struct_field().metadata)
            for f in [*view.ordered_fields, *view.partitions]
        )
    )


# ---------------------------------------------------------------- nested delimited text


class Cells:
    """Columns to delimited text and back, with one terminator per depth of nesting.

    The cells of a line are at depth 0. What holds several values at a depth puts that depth's terminator between
    them; the two parts of a map entry are one level below the entries, and what they hold is another level below.
    Null is ``\\N``. With an escape character, terminators, line ends and escapes inside texts follow an escape.
    """

    def __init__(self, text: TextFile) -> None:
        self.text, self.escape = text, text.escape

    def terminator(self, depth: int) -> str:
        return self.text.terminators(depth + 1)[depth]

    # -- to text

    def joined(self, values: Column, element: T.DataType, depth: int) -> Column:
        return F.array_join(F.transform(values, lambda v: self.encoded(v, element, depth + 1)), self.terminator(depth))

    def encoded(self, value: Column, kind: T.DataType, depth: int = 1) -> Column:
        below = depth + 1
        match kind:
            case T.ArrayType():
                cell = self.joined(value, kind.elementType, depth)
            case T.StructType():
                cell = F.concat_ws(self.terminator(depth), *(self.encoded(value[f.name], f.dataType, below) for f in kind))
            case T.MapType():
                parts = F.transform(
                    F.map_entries(value),
                    lambda e: F.concat_ws(
                        self.terminator(below),
                        self.encoded(e["key"], kind.keyType, below + 1),
                        self.encoded(e["value"], kind.valueType, below + 1),
                    ),
                )
                cell = F.array_join(parts, self.terminator(depth))
            case _:
                cell = self.escaped(value.cast("string"))
        return F.when(value.isNull(), NULL_TEXT).otherwise(cell)

    def escaped(self, value: Column) -> Column:
        if not self.escape:
            return value
        ends = self.text.line_terminator
        signs = "".join(re.escape(c) for c in [self.escape, *self.text.terminators(24)] if c != ends)
        kept = F.regexp_replace(value, f"([{signs}])", F.lit(f"{re.escape(self.escape)}$1"))
        return F.replace(kept, F.lit(ends), F.lit(f"{self.escape}n"))

    # -- and back

    def parts(self, value: Column, depth: int, limit: int = -1) -> Column:
        term = self.terminator(depth)
        if not self.escape:
            return F.split(value, re.escape(term), limit)
        mark, end = re.escape(self.escape), re.escape(term)
        return F.regexp_extract_all(F.concat(value, F.lit(term)), F.lit(f"(?s)((?:[^{mark}{end}]++|{mark}.)*+){end}"), F.lit(1))

    def items(self, value: Column, depth: int) -> Column:
        return F.when(value == "", F.array().cast("array<string>")).otherwise(self.parts(value, depth))

    def plain(self, value: Column) -> Column:
        if not self.escape:
            return value
        mark = re.escape(self.escape)
        pieces = F.regexp_extract_all(value, F.lit(f"(?s){mark}.|[^{mark}]++"), F.lit(0))
        meant = lambda p: F.when(p == f"{self.escape}n", self.text.line_terminator).otherwise(F.substring(p, 2, 1))
        whole = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith(self.escape), meant(p)).otherwise(p)), "")
        return F.when(value.contains(self.escape), whole).otherwise(value)

    def decoded(self, value: Column, kind: T.DataType, depth: int = 1) -> Column:
        """A value that does not parse becomes null."""
        below = depth + 1
        match kind:
            case T.ArrayType():
                out = F.transform(self.items(value, depth), lambda v: self.decoded(v, kind.elementType, below))
            case T.StructType():
                cells = self.parts(value, depth)
                out = F.struct(*(self.decoded(F.get(cells, i), f.dataType, below).alias(f.name) for i, f in enumerate(kind)))
            case T.MapType():

                def entry(e: Column) -> Column:
                    cells = self.parts(e, below, 2)
                    key, own = (self.decoded(F.get(cells, i), k, below + 1) for i, k in enumerate((kind.keyType, kind.valueType)))
                    return F.struct(key.alias("key"), own.alias("value"))

                out = F.map_from_entries(F.transform(self.items(value, depth), entry))
            case T.StringType():
                out = self.plain(value)
            case _:
                out = self.plain(value).try_cast(kind)
        return F.when(value.isNotNull() & (value != NULL_TEXT), out).cast(kind)


def encode_line(view: ViewDef, text: TextFile) -> Column:
    cells = Cells(text)
    return F.concat_ws(text.field_terminator, *(cells.encoded(F.col(f.column), f.data_type) for f in view.ordered_fields))


def decode_line(line: Column, view: ViewDef, text: TextFile) -> list[Column]:
    cells = Cells(text)
    parts = cells.parts(line, 0)
    return [cells.decoded(F.get(parts, i), f.data_type).alias(f.column) for i, f in enumerate(view.ordered_fields)]


# ---------------------------------------------------------------- readers and writers


def _csv_options(storage: Csv) -> dict[str, str]:
    return {
        "sep": storage.separator,
        "quote": storage.quote,
        "escape": storage.escape,
        "nullValue": NULL_TEXT,
        "emptyValue": "",
        "header": "false",
    }


# Key and value classes of Hadoop files of text lines.
LINE_KEY = "org.apache.hadoop.io.LongWritable"
NULL_KEY = "org.apache.hadoop.io.NullWritable"
LINE_VALUE = "org.apache.hadoop.io.Text"


def _has_avro_source(spark: SparkSession) -> bool:
    """Whether the session finds Spark's own Avro source, which is a module of its own."""
    try:
        sources = spark._jvm.org.apache.spark.sql.execution.datasources.DataSource
        sources.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
    except Exception:  # the gateway wraps what Spark throws
        return False
    return True


def _needs_hive(spark: SparkSession, view: ViewDef) -> bool:
    """Input/output formats with a serde, and RCFile."""
    match view.storage:
        case RecordColumnarFile():
            return True
        case InOutputFormat(serde=serde):
            return serde is not None
    return False


def _require_hive(spark: SparkSession, view: ViewDef) -> None:
    if spark.conf.get("spark.sql.catalogImplementation") != "hive":
        raise RuntimeError(f"{type(view.storage).__name__} tables need a session with Hive support")


def _save(writer: DataFrameWriter, source: str, path: str, partitions: Sequence[str]) -> None:
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.format(source).save(path)


def write_view(
    df: DataFrame,
    view: ViewDef,
    path: str,
    mode: str = "overwrite",
    dynamic: bool = False,
    balance: bool = True,
) -> None:
    """Write ``df`` as the view under ``path``.

    With partitions the rows are rebalanced on the partition columns first:
    adaptive execution splits a hot partition over many tasks and merges tiny
    ones, so no partition is funnelled through one writer.
    """
    if view.external:
        raise ValueError(f"{view.name} is external: it may only be read")
    rows = conform(df, view)
    partitions = view.partition_columns
    if partitions and balance:
        rows = rows.hint("rebalance", *(F.col(c) for c in partitions))

    storage = view.storage
    if _needs_hive(df.sparkSession, view):
        _write_hive_table(rows, view, path, mode)
        return
    if isinstance(storage, (SequenceFile, InOutputFormat)):
        _write_hadoop_lines(rows, view, path, mode)
        return
    if isinstance(storage, Avro) and not _has_avro_source(df.sparkSession):
        _write_avro(rows, view, path, mode, dynamic)
        return

    options: dict[str, str] = dict(view.write_options)
    options["partitionOverwriteMode"] = "dynamic" if dynamic else "static"
    match storage:
        case Parquet():
            source = "parquet"
        case Orc():
            source = "orc"
        case Avro(schema_path):
            source = "avro"
            options = {"avroSchemaUrl": schema_path, **options}
        case Json():
            source = "json"
            options.setdefault("ignoreNullFields", "false")
        case Csv():
            source = "csv"
            options = {**_csv_options(storage), **options}
        case TextFile():
            source = "text"
            rows = rows.select(encode_line(view, storage).alias("value"), *partitions)
            options["lineSep"] = storage.line_terminator
        case RegexText():
            raise ValueError("regex text is a format for reading only")
        case _:
            raise ValueError(f"unknown storage format {storage!r}")
    _save(rows.write.mode(mode).options(**options), source, path, partitions)


def _partition_columns(view: ViewDef) -> list[Column]:
    return [F.col(f.column).cast(f.data_type).alias(f.column) for f in view.partitions]


def read_view(spark: SparkSession, view: ViewDef, path: str, recursive: bool = False) -> DataFrame:
    """Read the view with its declared schema; nothing is inferred.

    ``recursive`` reads the files of all folders below, whose names then tell no partition; only file formats of Spark's
    own take it.
    """
    storage = view.storage
    files = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if recursive and not isinstance(storage, (Parquet, Orc, Json, Csv, TextFile, RegexText)):
        raise ValueError(f"{type(storage).__name__} files are not read recursively")
    match storage:
        case Parquet():
            return files.schema(view.schema).parquet(path)
        case Orc():
            return files.schema(view.schema).orc(path)
        case Json():
            return files.schema(view.schema).json(path)
        case Csv():
            return files.schema(view.schema).options(**_csv_options(storage)).csv(path)
        case TextFile() | RegexText():
            schema = T.StructType(
                [T.StructField("value", T.StringType()), *(f.struct_field() for f in view.partitions)]
            )
            reader = files.schema(schema)
            if isinstance(storage, TextFile):
                lines = reader.option("lineSep", storage.line_terminator).format("text").load(path)
                return lines.select(*decode_line(F.col("value"), view, storage), *_partition_columns(view))
            lines = reader.format("text").load(path)
            return lines.select(*regex_columns(F.col("value"), view, storage.pattern), *_partition_columns(view))
        case SequenceFile(text):
            lines = spark.sparkContext.sequenceFile(path)
            return _lines_frame(spark, lines).select(*decode_line(F.col("value"), view, text))
        case InOutputFormat(input=input_class, serde=None):
            lines = spark.sparkContext.hadoopFile(path, input_class, LINE_KEY, LINE_VALUE)
            return _lines_frame(spark, lines).select(*decode_line(F.col("value"), view, TextFile()))
        case Avro(schema_path) if _has_avro_source(spark):
            return spark.read.format("avro").option("avroSchemaUrl", schema_path).load(path)
        case Avro():
            return _read_avro(spark, view, path)
    _require_hive(spark, view)
    return spark.table(view.table_name())


FOLDER = "_folder"


def _write_avro(rows: DataFrame, view: ViewDef, path: str, mode: str, dynamic: bool) -> None:
    """Container files of our own source, where Spark's is not installed; partitions are folders."""
    avro.register(rows.sparkSession)
    options = {"recordName": view.short_name(), **view.write_options}
    if view.partitions:
        texts = (F.concat(F.lit(f"{c}="), path_value(F.col(c))) for c in view.partition_columns)
        rows = rows.withColumn(FOLDER, F.concat_ws("/", *texts)).drop(*view.partition_columns).sortWithinPartitions(FOLDER)
        options |= {"folderColumn": FOLDER, "dynamic": str(dynamic).lower()}
    rows.write.format(avro.FORMAT).mode(mode).options(**options).save(path)


def _read_avro(spark: SparkSession, view: ViewDef, path: str) -> DataFrame:
    avro.register(spark)
    if not view.partitions:
        return spark.read.format(avro.FORMAT).schema(view.data_schema).load(path)
    schema = T.StructType([*view.data_schema, T.StructField(FOLDER, T.StringType())])
    rows = spark.read.format(avro.FORMAT).schema(schema).option("folderColumn", FOLDER).load(path)
    values = [
        value_of_path(F.regexp_extract(FOLDER, rf"(?:^|/){re.escape(f.column)}=([^/]*)", 1)).cast(f.data_type).alias(f.column)
        for f in view.partitions
    ]
    return rows.select(*(F.col(f"`{f.name}`") for f in view.data_schema), *values)


def _lines_frame(spark: SparkSession, keyed_lines: RDD) -> DataFrame:
    return spark.createDataFrame(keyed_lines.map(lambda kv: (kv[1],)), "value string", verifySchema=False)


def _write_hadoop_lines(rows: DataFrame, view: ViewDef, path: str, mode: str) -> None:
    """Delimited lines in a sequence file or a custom Hadoop format; Spark has no DataFrame sink for them."""
    if view.partitions:
        raise ValueError(f"partitioned {type(view.storage).__name__} tables need a session with Hive support")
    text = view.storage.text if isinstance(view.storage, SequenceFile) else TextFile()
    lines = rows.select(encode_line(view, text).alias("value")).rdd.map(lambda r: (None, r.value))
    if mode == "overwrite":
        remove_folder(rows.sparkSession, path)
    if isinstance(view.storage, SequenceFile):
        lines.saveAsSequenceFile(path)
    else:
        lines.saveAsHadoopFile(path, view.storage.output, keyClass=NULL_KEY, valueClass=LINE_VALUE)


def regex_columns(line: Column, view: ViewDef, pattern: str) -> list[Column]:
    """One capture group per column. The whole line has to match, else all are null."""
    anchored = f"^(?:{pattern})$"
    matched = line.rlike(anchored)
    return [
        F.when(matched, F.regexp_extract(line, anchored, i)).try_cast(f.data_type).alias(f.column)
        for i, f in enumerate(view.ordered_fields, start=1)
    ]


def _write_hive_table(rows: DataFrame, view: ViewDef, path: str, mode: str) -> None:
    """RCFile and custom input/output formats go through a Hive table."""
    spark = rows.sparkSession
    _require_hive(spark, view)
    root = path.removesuffix(f"/{view.database}/{view.short_name()}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {view.database}")
    spark.sql(create_table_statement(view, root))
    rows.write.insertInto(view.table_name(), overwrite=mode == "overwrite")
