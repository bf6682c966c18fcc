"""Export to relational databases: temporary table, then one merging transaction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.exports.common import BATCH_ROWS, WRITERS, compact_filter, observed
from viewforge.functions.digests import DEFAULT_SALT, anonymize, is_complex, json_text
from viewforge.session import remove_folder, scratch_path, stored

# Column types per database dialect.
COLUMN_TYPES = {
    "mysql": {
        "string": "text",
        "boolean": "boolean",
        "int": "int",
        "bigint": "bigint",
        "double": "double",
        "float": "float",
        "tinyint": "tinyint",
    },
    "postgresql": {
        "string": "text",
        "boolean": "boolean",
        "int": "integer",
        "bigint": "bigint",
        "double": "double precision",
        "float": "real",
        "tinyint": "smallint",
    },
    "exasol": {
        "string": "varchar(100000)",
        "boolean": "boolean",
        "int": "int",
        "bigint": "bigint",
        "double": "double",
        "float": "float",
        "tinyint": "int",
    },
    "derby": {
        "string": "varchar(32000)",
        "boolean": "boolean",
        "int": "int",
        "bigint": "bigint",
        "double": "double",
        "float": "float",
        "tinyint": "int",
    },
}
URL_PREFIXES = {
    "jdbc:mysql": "mysql",
    "jdbc:postgresql": "postgresql",
    "jdbc:exa": "exasol",
    "jdbc:derby": "derby",
}
RENAMED_COLUMNS = {"year": "data_year", "month": "data_month", "day": "data_day"}
FILTER_COLUMN = "used_filter"
ROW_COLUMN = "export_row"
MYSQL_ENGINE = "InnoDB"


def dialect_of(url: str) -> str:
    for prefix, dialect in URL_PREFIXES.items():
        if url.startswith(prefix):
            return dialect
    raise ValueError(f"no dialect for {url}")


def column_types(schema: T.StructType, dialect: str) -> dict[str, str]:
    """Database type per column; timestamps, dates and decimals keep their own names."""
    types = COLUMN_TYPES[dialect]
    result = {}
    for f in schema:
        name = f.dataType.simpleString()
        if is_complex(f.dataType):
            name = "string"
        if name in types:
            result[f.name] = types[name]
        elif name == "smallint":
            result[f.name] = "smallint"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            result[f.name] = "timestamp"
        elif isinstance(f.dataType, (T.DateType, T.DecimalType)):
            result[f.name] = name
        else:
            raise ValueError(f"no {dialect} type for {f.name}: {name}")
    return result


def table_options(dialect: str, engine: str = MYSQL_ENGINE, distribute_by: str | None = None) -> str:
    """What follows the column list of a created table."""
    if dialect == "mysql":
        return f"ENGINE={engine} DEFAULT CHARSET=utf8"
    if dialect == "exasol" and distribute_by:
        return f"DISTRIBUTE BY {distribute_by}"
    return ""


def create_statement(
    table: str, schema: T.StructType, dialect: str, engine: str = MYSQL_ENGINE, distribute_by: str | None = None
) -> str:
    columns = ", ".join(f"{name} {kind}" for name, kind in column_types(schema, dialect).items())
    options = table_options(dialect, engine, distribute_by)
    if dialect == "exasol" and options:
        return f"CREATE TABLE {table} ({columns}, {options})"
    return f"CREATE TABLE {table} ({columns}) {options}".rstrip()


def jdbc_encode(
    df: DataFrame,
    filter_text: str | None = None,
    private: Sequence[str] = (),
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Rows as they are inserted: hashed, complex columns as JSON, the filter last."""
    plain = anonymize(df, private, salt)
    columns = [
        (json_text(F.col(f.name)) if is_complex(f.dataType) else F.col(f.name)).alias(
            RENAMED_COLUMNS.get(f.name, f.name)
        )
        for f in plain.schema
    ]
    used = compact_filter(filter_text) if filter_text else F.lit(None).cast("string")
    return plain.select(*columns, used.alias(FILTER_COLUMN))


def output_table(database: str, table: str) -> str:
    return f"{database}_{table}"


def temporary_table(target: str, filter_text: str | None) -> str:
    """Named by the filter as well, in a few characters, since databases bound the length of names."""
    own = "" if filter_text is None else "_" + hashlib.sha256(filter_text.encode()).hexdigest()[:12]
    return f"tmp_{target}{own}"


def merge_statements(
    table: str,
    temporary: str,
    schema: T.StructType,
    dialect: str,
    table_exists: bool,
    filter_text: str | None = None,
    **options: str,
) -> list[str]:
    """The statements that move a filled temporary table into the target.

    With a filter only the rows exported under that filter are replaced, without
    one the whole table. Rows that a repeated task inserted twice carry the same
    row number and count once. Run the statements in one transaction.
    """
    statements = []
    if filter_text is None and table_exists:
        statements.append(f"DROP TABLE {table}")
        table_exists = False
    if not table_exists:
        statements.append(create_statement(table, schema, dialect, **options))
    elif filter_text is not None:
        compact = filter_text.translate(str.maketrans("", "", " '\""))
        statements.append(f"DELETE FROM {table} WHERE {FILTER_COLUMN} = '{compact}'")
    names = ", ".join(f.name for f in schema)
    statements.append(
        f"INSERT INTO {table} ({names}) SELECT {names} FROM "
        f"(SELECT DISTINCT {ROW_COLUMN}, {names} FROM {temporary}) numbered"
    )
    statements.append(f"DROP TABLE {temporary}")
    return statements


def merged_rows(target: DataFrame | None, staged: DataFrame, filter_text: str | None = None) -> DataFrame:
    """What :func:`merge_statements` leaves in the target, as a frame over copies of both tables.

    Serves to check a target after an export, and to merge where the target is a
    table Spark itself keeps.
    """
    new = staged.dropDuplicates([ROW_COLUMN]).drop(ROW_COLUMN)
    if target is None or filter_text is None:
        return new
    replaced = compact_filter(filter_text)
    return target.where(~F.col(FILTER_COLUMN).eqNullSafe(replaced)).unionByName(new)


def numbered(encoded: DataFrame, path: str) -> DataFrame:
    """Rows with a fixed number each, stored under ``path`` so that retries see the same numbers."""
    return stored(encoded.withColumn(ROW_COLUMN, F.monotonically_increasing_id()), path)


def jdbc_write(
    rows: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    writers: int = WRITERS,
    batch_rows: int = BATCH_ROWS,
) -> None:
    """Append rows to an existing table over ``writers`` connections, in batches. ``partial`` gives :func:`jdbc_export` other settings."""
    rows.repartition(writers).write.format("jdbc").mode("append").options(
        url=url, dbtable=table, batchsize=batch_rows, numPartitions=writers, **(properties or {})
    ).save()


def jdbc_export(
    df: DataFrame,
    url: str,
    database: str,
    table: str,
    execute: Callable[[Sequence[str]], None],
    table_exists: Callable[[str], bool],
    filter_text: str | None = None,
    private: Sequence[str] = (),
    salt: str = DEFAULT_SALT,
    write: Callable[[DataFrame, str, str], None] = jdbc_write,
) -> dict[str, int]:
    """Encode, fill a temporary table, merge. A failed export leaves only the old rows. Returns how many rows were merged.

    ``execute`` runs statements in one transaction on the driver; see
    :func:`jdbc_executor`. Every filter has a temporary table of its own, so partitions can be exported side by side.
    """
    dialect = dialect_of(url)
    target = output_table(database, table)
    temporary = temporary_table(target, filter_text)
    encoded = jdbc_encode(df, filter_text, private, salt)
    staging = scratch_path(df.sparkSession, "jdbc")
    try:
        counted, seen = observed(encoded)
        rows = numbered(counted, staging)
        leftover = [f"DROP TABLE {temporary}"] if table_exists(temporary) else []
        execute([*leftover, create_statement(temporary, rows.schema, dialect)])
        write(rows, url, temporary)
        execute(merge_statements(target, temporary, encoded.schema, dialect, table_exists(target), filter_text))
        return seen.get
    except Exception:
        if table_exists(temporary):
            execute([f"DROP TABLE {temporary}"])
        raise
    finally:
        remove_folder(df.sparkSession, staging)


def jdbc_executor(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> Callable[[Sequence[str]], None]:
    """Runs statements in one transaction through the driver's JVM."""

    def execute(statements: Sequence[str]) -> None:
        settings = spark._jvm.java.util.Properties()
        for key, value in (properties or {}).items():
            settings.setProperty(key, value)
        connection = spark._jvm.java.sql.DriverManager.getConnection(url, settings)
        try:
            connection.setAutoCommit(False)
            for statement in statements:
                prepared = connection.createStatement()
                prepared.executeUpdate(statement)
                prepared.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return execute
