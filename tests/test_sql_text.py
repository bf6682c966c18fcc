"""Substitution, statement splitting, normalisation, digests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewforge.functions.digests import anonymize, digest, digest_groups
from viewforge.functions.sqltext import normalize_sql
from viewforge.operators.state import transformation_changes, transformation_checksums
from viewforge.plans.transform import (
    register_functions,
    run_then_export,
    split_statements,
    sql_transform,
    substitute,
)


@pytest.mark.parametrize(
    "text, params, expected",
    [
        ("${a} ${a} ${b}", {"a": "A", "b": True}, "A A true"),
        ("id = ${a}", {"a": "1; DROP TABLE"}, r"id = 1\; DROP TABLE"),
        ('id = "${a}"', {"a": '1"; DROP TABLE test;"x'}, r'id = "1\"\; DROP TABLE test\;\"x"'),
        ("id = '${a}'", {"a": "1'; DROP TABLE test;'x"}, r"id = '1\'\; DROP TABLE test\;\'x'"),
        ("id = §{a}", {"a": "1; DROP TABLE"}, r"id = 1\; DROP TABLE"),
        ('id = "§{a}"', {"a": '1"; DROP TABLE test;"x'}, r'id = "1"\; DROP TABLE test\;"x"'),
        ("id = '§{a}'", {"a": "1'; DROP TABLE test;'x"}, r"id = '1'\; DROP TABLE test\;'x'"),
        ("${unknown}", {"a": 1}, "${unknown}"),
    ],
)
def test_substitution(text, params, expected):
    assert substitute(text, params) == expected


def test_splitting():
    assert split_statements(r"SELECT 1; SELECT '\;' ;; ") == ["SELECT 1", "SELECT ';'"]


CASES = [
    (
        "-----23123-xcvo\tn .cvaotrsaooiarst9210132q56`]-[ taroistneaorsitdthdastrtsra\n"
        "--a comment\n\\--no comment\n--\nselect * from coolstuff\nLIMIT 10",
        "\\--no comment select * from coolstuff LIMIT 10",
    ),
    ("   \t\t\t    test \t \n  \t \tte\tst    \nwh at\t   ", "test te st wh at"),
    (
        "NOSET key=value;\nSET test=hello; \nset test=hi; \nset settings=hi; \nSET test=key; SET hello=world;\n"
        "SET test=key; SET hello=world; hello\nSELECT;",
        "NOSET key=value; hello SELECT;",
    ),
    ('"this  is"   a\ttest', '"this;;is" a test'),
    ("'this  is'   a\ttest", "'this;;is' a test"),
    ("'  '  '  ' ", "';;' ';;'"),
    ("'  \\'  '  '  \\'  ' ", "';;\\';;' ';;\\';;'"),
    ('te"st', 'te"st'),
    ('hi"  " test " "hi', 'hi";;" test ";"hi'),
    ('" te\\"st\\" "', '";te\\"st\\";"'),
    ("select * from\t\nprices  where id = '12  23'", "select * from prices where id = '12;;23'"),
]


def test_normalisation(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, sql string")
    got = {r.i: r.n for r in df.select("i", normalize_sql(F.col("sql")).alias("n")).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}


def test_long_quoted_text_is_normalised(spark):
    long = "'" + "x y " * 60000 + "'"
    row = spark.createDataFrame([(f"SELECT  {long}",)], "sql string").select(normalize_sql(F.col("sql")).alias("n")).collect()
    assert row[0].n == "SELECT '" + "x;y;" * 60000 + "'"


def test_transformation_checksums(spark):
    base = "SELECT price\nFROM t WHERE d = 'a b'"
    rows = [
        ("same", f"SET memory=1;\n-- note\n\n{base}", [], None),
        ("plain", base, [], None),
        ("quoted", base.replace("a b", "a  b"), [], None),
        ("resource", base, ["jar1"], None),
        ("version", base, [], "v7"),
        ("version_other", "SELECT 1", [], "v7"),
    ]
    df = spark.createDataFrame(rows, "view string, sql string, resources array<string>, version string")
    sums = {r.view: r.checksum for r in transformation_checksums(df).collect()}
    assert sums["same"] == sums["plain"]
    assert len({sums["plain"], sums["quoted"], sums["resource"], sums["version"]}) == 4
    assert sums["version"] == sums["version_other"]
    state = spark.createDataFrame(
        [("plain", "p1", sums["same"]), ("quoted", "p1", sums["same"]), ("quoted", "p2", None)],
        "view string, partition string, checksum string",
    )
    changed = transformation_changes(state, df).collect()
    assert sorted((r.view, r.partition) for r in changed) == [("quoted", "p1"), ("quoted", "p2")]


def test_digest(spark):
    import hashlib

    row = spark.range(1).select(
        digest(F.array(F.lit("b"), F.lit("a"))).alias("two"), digest(F.array().cast("array<string>")).alias("none")
    ).collect()[0]
    assert row.two == hashlib.md5(b"ab").hexdigest().upper()
    assert row.none == "0"


def test_group_digest_ignores_order_but_not_copies(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("c", "y"), ("d", None)], "g string, t string"
    )
    got = {r.g: r.digest for r in digest_groups(df, ["g"], "t").collect()}
    assert got["a"] == got["b"] != got["c"]
    assert got["d"] == "0"


def test_anonymize_golden(spark):
    df = spark.createDataFrame([("abcd", 1, None, [1])], "s string, i int, n string, a array<int>")
    out = anonymize(df, ["s", "i", "n", "a", "absent"], "vD75MqvaasIlCf7H")
    row = out.collect()[0]
    assert row.s == "cbcc359878fbe2238c064a6caa240370"
    assert len(row.i) == 32 and row.n is None and row.a == [1]


def test_transform_stops_at_the_first_failure_and_restores_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    text = "SET spark.sql.shuffle.partitions=3; CREATE OR REPLACE TEMPORARY VIEW tv AS SELECT 1 AS x; SELECT * FROM absent; SELECT 2"
    with pytest.raises(Exception, match="absent"):
        sql_transform(spark, text)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sql_transform(spark, "SELECT x + :n AS y FROM tv", args={"n": 4}).collect() == [(5,)]


def test_settings_hold_while_the_result_is_written(spark):
    def partitions(df):
        return df.sparkSession.conf.get("spark.sql.shuffle.partitions")

    assert sql_transform(spark, "SET spark.sql.shuffle.partitions=3; SELECT 1", write=partitions) == "3"


def test_functions_are_registered_once(spark):
    assert register_functions(spark, {"twice_of": lambda s: s + s}) == ["twice_of"]
    assert register_functions(spark, {"twice_of": lambda s: s, "upper": lambda s: s}) == []
    assert spark.sql("SELECT twice_of('a') AS x").collect() == [("aa",)]


def test_muted_exports_do_not_run(spark):
    seen = []
    stored, errors = run_then_export(spark.range(3), lambda df: df, [seen.append], muted=True)
    assert stored.count() == 3 and errors == [] and seen == []
