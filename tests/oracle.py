"""Compare a registered query with its SQL on the same files."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from viewforge_queries.common import TABLES  # noqa: E402

SAME_TYPES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    return value


def differences(df, connection, sql: str) -> list[str]:
    """Empty when names, types, row count and values agree."""
    names = sorted(df.columns)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()]
    result = connection.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    if sorted(described) != names:
        return [f"columns {names} but {sorted(described)}"]
    order = [list(described).index(n) for n in names]
    expected = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    problems = []
    for n in names:
        want = SAME_TYPES.get(df.schema[n].dataType.simpleString())
        if want != described[n]:
            problems.append(f"type of {n}: {df.schema[n].dataType.simpleString()} but {described[n]}")
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows but {len(expected)}")
    left, right = sorted(rows, key=repr), sorted(expected, key=repr)
    for a, b in zip(left, right):
        if a != b:
            problems.append(f"{str(a)[:600]} but {str(b)[:600]}")
            break
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from viewforge.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("check", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problems = differences(df, connection, oracles[name])
                note = f"{connection.execute('SELECT COUNT(*) FROM (' + oracles[name] + ') q').fetchall()[0][0]} rows"
            else:
                problems, note = [], f"{df.count()} rows, no oracle"
        except Exception as problem:  # noqa: BLE001
            problems, note = [f"{type(problem).__name__}: {str(problem)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name} {time.time() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
