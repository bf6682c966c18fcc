"""View declarations: typed fields, partition columns, storage format, placement."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Order weights that place the standard columns.
DEFAULT_WEIGHT = 100
ID_WEIGHT = 2147483647
OCCURRED_WEIGHT = 1000
OCCURRED_UNTIL_WEIGHT = 999
CREATED_AT_WEIGHT = 1
CREATED_BY_WEIGHT = 0


def snake_case(name: str) -> str:
    """Every capital becomes an underscore and its small letter; no leading underscore."""
    return re.sub(r"([A-Z])", lambda m: "_" + m.group(1).lower(), name).removeprefix("_")


@dataclass(frozen=True)
class Field:
    """One typed column. ``type`` is a Spark type or its DDL text."""

    name: str
    type: T.DataType | str
    comment: str | None = None
    privacy: bool = False
    weight: int = DEFAULT_WEIGHT
    override: str | None = None

    @property
    def column(self) -> str:
        return snake_case(self.override or self.name)

    @property
    def data_type(self) -> T.DataType:
        return self.type if isinstance(self.type, T.DataType) else T.DataType.fromDDL(self.type)

    def struct_field(self) -> T.StructField:
        metadata = {"privacy": self.privacy, "weight": self.weight}
        if self.comment:
            metadata["comment"] = self.comment
        return T.StructField(self.column, self.data_type, True, metadata)


ID = Field("id", "string", weight=ID_WEIGHT)
OCCURRED_AT = Field("occurredAt", "string", weight=OCCURRED_WEIGHT)
OCCURRED_FROM = Field("occurredFrom", "string", weight=OCCURRED_WEIGHT)
OCCURRED_UNTIL = Field("occurredUntil", "string", weight=OCCURRED_UNTIL_WEIGHT)
CREATED_AT = Field("createdAt", "string", weight=CREATED_AT_WEIGHT)
CREATED_BY = Field("createdBy", "string", weight=CREATED_BY_WEIGHT)
JOB_METADATA = (CREATED_AT, CREATED_BY)
MONTHLY = (Field("year", "string"), Field("month", "string"), Field("monthId", "string"))
DAILY = (
    Field("year", "string"),
    Field("month", "string"),
    Field("day", "string"),
    Field("dateId", "string"),
)


# ---------------------------------------------------------------- storage formats


@dataclass(frozen=True)
class Parquet:
    pass


@dataclass(frozen=True)
class Orc:
    pass


@dataclass(frozen=True)
class Json:
    pass


@dataclass(frozen=True)
class Csv:
    separator: str = ","
    quote: str = '"'
    escape: str = "\\"


@dataclass(frozen=True)
class TextFile:
    """Delimited text; nested values use the item and map-key terminators, deeper ones control characters of their own.

    With an ``escape`` character, terminators inside text values are kept.
    """

    field_terminator: str = "\t"
    item_terminator: str = "\x02"
    map_key_terminator: str = "\x03"
    line_terminator: str = "\n"
    escape: str | None = None

    def __post_init__(self) -> None:
        if self.escape and any(len(t) != 1 or t == self.escape for t in [*self.terminators(3), self.line_terminator]):
            raise ValueError("escaped text needs terminators of one character, other than the escape")

    def terminators(self, depth: int) -> list[str]:
        """One terminator per depth of nesting: fields, items, map keys, and then control characters not in use."""
        given = [self.field_terminator, self.item_terminator, self.map_key_terminator]
        taken = {*given, self.line_terminator, self.escape, "\t", "\n", "\r"}
        free = [c for c in map(chr, range(4, 32)) if c not in taken]
        if depth > len(given) + len(free):
            raise ValueError(f"no terminator for {depth} levels")
        return [*given, *free][:depth]


@dataclass(frozen=True)
class RegexText:
    """One regex group per column; a line that does not match gives nulls."""

    pattern: str


@dataclass(frozen=True)
class SequenceFile:
    text: TextFile = field(default_factory=TextFile)


@dataclass(frozen=True)
class RecordColumnarFile:
    pass


@dataclass(frozen=True)
class InOutputFormat:
    input: str
    output: str
    serde: str | None = None


@dataclass(frozen=True)
class Avro:
    schema_path: str


StorageFormat = (
    Parquet | Orc | Json | Csv | TextFile | RegexText | SequenceFile | RecordColumnarFile | InOutputFormat | Avro
)


# ---------------------------------------------------------------- views


@dataclass(frozen=True)
class ViewDef:
    """A table declaration.

    ``partitions`` become partition columns, in declaration order. ``suffixes``
    are parameters that select a table instead of a directory.
    """

    name: str
    fields: Sequence[Field]
    package: str = "default"
    environment: str = "dev"
    partitions: Sequence[Field] = ()
    suffixes: Sequence[Field] = ()
    storage: StorageFormat = field(default_factory=Parquet)
    table_properties: Mapping[str, str] = field(default_factory=dict)
    write_options: Mapping[str, str] = field(default_factory=dict)
    comment: str | None = None
    materialize_once: bool = False
    external: bool = False

    @property
    def ordered_fields(self) -> list[Field]:
        """Heaviest first; equal weights keep declaration order."""
        return sorted(self.fields, key=lambda f: -f.weight)

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.ordered_fields]

    @property
    def partition_columns(self) -> list[str]:
        return [f.column for f in self.partitions]

    @property
    def privacy_columns(self) -> list[str]:
        return [f.column for f in [*self.ordered_fields, *self.partitions] if f.privacy]

    @property
    def data_schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.ordered_fields])

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in [*self.ordered_fields, *self.partitions]])

    @property
    def database(self) -> str:
        return f"{self.environment}_{self.package.replace('.', '_')}"

    def short_name(self, suffix_values: Sequence[object] = ()) -> str:
        return "_".join([snake_case(self.name), *(str(v).lower() for v in suffix_values)])

    def table_name(self, suffix_values: Sequence[object] = ()) -> str:
        return f"{self.database}.{self.short_name(suffix_values)}"

    def path(self, root: str, suffix_values: Sequence[object] = ()) -> str:
        """``root`` may carry any scheme and bucket."""
        return f"{root.rstrip('/')}/{self.database}/{self.short_name(suffix_values)}"

    def partition_path(self, params: Mapping[str, object]) -> str:
        """``/p1=v1/p2=v2`` in declaration order."""
        return "".join(f"/{c}={escape_path_value(params[c])}" for c in self.partition_columns)

    def with_storage(self, storage: StorageFormat) -> ViewDef:
        return replace(self, storage=storage)


# The directory name of a null, and characters that may not stand in such a name.
NULL_PATH_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED_PATH_CHARACTERS = "\"#%'*/:=?\\\x7f{[]^"


def escape_path_value(value: object) -> str:
    if value is None or value == "":
        return NULL_PATH_VALUE
    return "".join(f"%{ord(c):02X}" if c in ESCAPED_PATH_CHARACTERS or ord(c) < 32 else c for c in str(value))


# ---------------------------------------------------------------- declarations as SQL text


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def storage_clause(storage: StorageFormat) -> str:
    match storage:
        case Parquet():
            return "STORED AS PARQUET"
        case Orc():
            return "STORED AS ORC"
        case RecordColumnarFile():
            return "STORED AS RCFILE"
        case Avro():
            return "STORED AS AVRO"
        case Json():
            return "ROW FORMAT SERDE 'org.apache.hive.hcatalog.data.JsonSerDe' STORED AS TEXTFILE"
        case Csv(separator, quote, escape):
            properties = ", ".join(
                f"{_sql_string(k)}={_sql_string(v)}"
                for k, v in {"separatorChar": separator, "quoteChar": quote, "escapeChar": escape}.items()
            )
            return (
                "ROW FORMAT SERDE 'org.apache.hadoop.hive.serde2.OpenCSVSerde' "
                f"WITH SERDEPROPERTIES ({properties}) STORED AS TEXTFILE"
            )
        case RegexText(pattern):
            return (
                "ROW FORMAT SERDE 'org.apache.hadoop.hive.serde2.RegexSerDe' "
                f"WITH SERDEPROPERTIES ('input.regex'={_sql_string(pattern)}) STORED AS TEXTFILE"
            )
        case TextFile():
            return f"{_delimited_clause(storage)} STORED AS TEXTFILE"
        case SequenceFile(text):
            return f"{_delimited_clause(text)} STORED AS SEQUENCEFILE"
        case InOutputFormat(input, output, serde):
            row_format = f"ROW FORMAT SERDE {_sql_string(serde)} " if serde else ""
            return f"{row_format}STORED AS INPUTFORMAT {_sql_string(input)} OUTPUTFORMAT {_sql_string(output)}"
    raise ValueError(f"unknown storage format {storage!r}")


def _delimited_clause(text: TextFile) -> str:
    escaped = f"ESCAPED BY {_sql_string(text.escape)} " if text.escape else ""
    return (
        f"ROW FORMAT DELIMITED FIELDS TERMINATED BY {_sql_string(text.field_terminator)} {escaped}"
        f"COLLECTION ITEMS TERMINATED BY {_sql_string(text.item_terminator)} "
        f"MAP KEYS TERMINATED BY {_sql_string(text.map_key_terminator)} "
        f"LINES TERMINATED BY {_sql_string(text.line_terminator)}"
    )


def _column_clause(f: Field) -> str:
    comment = f" COMMENT {_sql_string(f.comment)}" if f.comment else ""
    return f"`{f.column}` {f.data_type.simpleString()}{comment}"


def create_table_statement(view: ViewDef, root: str, suffix_values: Sequence[object] = ()) -> str:
    """``CREATE EXTERNAL TABLE IF NOT EXISTS`` for one table of the view.

    Avro tables list no columns: they come from the schema file.
    """
    parts = [f"CREATE EXTERNAL TABLE IF NOT EXISTS {view.table_name(suffix_values)}"]
    properties = dict(view.table_properties)
    if isinstance(view.storage, Avro):
        properties["avro.schema.url"] = view.storage.schema_path
    else:
        parts.append("(" + ", ".join(_column_clause(f) for f in view.ordered_fields) + ")")
    if view.comment:
        parts.append(f"COMMENT {_sql_string(view.comment)}")
    if view.partitions:
        parts.append("PARTITIONED BY (" + ", ".join(_column_clause(f) for f in view.partitions) + ")")
    parts.append(storage_clause(view.storage))
    parts.append(f"LOCATION {_sql_string(view.path(root, suffix_values))}")
    if properties:
        body = ", ".join(f"{_sql_string(k)}={_sql_string(v)}" for k, v in properties.items())
        parts.append(f"TBLPROPERTIES ({body})")
    return " ".join(parts)


def declaration_text(view: ViewDef, root: str = "") -> str:
    """The text whose digest tells a changed declaration; an Avro schema path does not count."""
    if isinstance(view.storage, Avro):
        view = view.with_storage(Avro(""))
    return create_table_statement(view, root)
