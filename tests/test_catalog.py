"""Profiles, facets, lineage and generated rows on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.operators import facets, fixtures, lineage, profile
from viewforge.operators.facets import Facet
from viewforge.operators.joins import not_in


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", True, [1], {"a": 1}), (3, "a", None, [], None), (None, None, False, [1, 2], {})],
        "n int, s string, f boolean, l array<int>, m map<string,int>",
    )
    row = profile.profile_table(df).collect()[0].asDict()
    assert (row["agg_rows"], row["n__min"], row["n__max"], row["n__avg"], row["n__stddev"], row["n__sum"]) == (3, 1, 3, 2.0, 1.0, 4)
    assert (row["s__min"], row["s__max"], row["f__true"], row["f__false"]) == ("a", "b", 1, 2)
    assert (row["l__min"], row["l__max"], row["m__max"]) == (0, 2, 1)
    long = {r.metric: r.value for r in profile.profile_long(df, "db.t").collect()}
    assert long["agg_rows"] == "3" and long["s__max"] == "b"


def test_samples_refuse_unknown_parameters(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(40)], "i int, p string")
    assert [r.i for r in profile.sample_partition(df, {"p": "x"}, ["i"], 3).collect()] == [1, 3, 5]
    with pytest.raises(ValueError):
        profile.sample_partition(df, {"absent": "x"}, ["i"])


def test_parameter_values_in_order_of_first_text(spark):
    df = spark.createDataFrame([("b=2/a=9",), ("b=10/a=8",), ("b=10/a=9",)], "partition string")
    got = {r.parameter: r.vals for r in profile.parameter_values(df).collect()}
    assert got == {"b": ["10", "2"], "a": ["8", "9"]}


def test_partition_sizes(spark, tmp_path):
    spark.range(20).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(str(tmp_path / "t"))
    rows = {r.p: r for r in profile.partition_sizes(spark, str(tmp_path / "t"), ["p"]).collect()}
    assert set(rows) == {"0", "1"} and all(r.n_bytes > 0 and r.n_files >= 1 for r in rows.values())


def test_status_filter_matches_whole_names(spark):
    df = spark.createDataFrame(
        [("orders", "materialized", True, True), ("orders_old", "failed", True, False), ("orders", "waiting", True, True)],
        "view string, status string, incomplete boolean, with_errors boolean",
    )
    assert profile.status_filter(df, name_regex="orders").count() == 2
    assert profile.status_filter(df, name_regex="a|orders").count() == 2
    assert profile.status_filter(df, issue="incomplete").count() == 2
    assert profile.status_filter(df, issue="incomplete AND errors").count() == 1


DOCS = [
    (1, "Alpha beta", "en", ["x", "y"]),
    (2, "alpha", "de", ["x"]),
    (3, "beta (gamma)", "en", ["y"]),
    (4, None, "fr", []),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string, lang string, tags array<string>")


def test_search_terms(spark):
    assert [r.id for r in facets.facet_search_terms(docs(spark), ["text", "lang"], "ALPHA en").collect()] == [1]
    assert facets.facet_search_terms(docs(spark), ["text"], " ").count() == 4


def test_facets(spark):
    fs = [Facet("lang", exclude_own=True), Facet("tags", "AND")]
    both = facets.facet_filter(docs(spark), fs, {"lang": ["en", "de"], "tags": ["x"]})
    assert sorted(r.id for r in both.collect()) == [1, 2]
    counts = {(r.facet, r.value): r.n for r in facets.facet_counts(docs(spark), fs, {"lang": ["de"], "tags": ["x"]}).collect()}
    assert counts == {("lang", "en"): 1, ("lang", "de"): 1, ("tags", "x"): 1}


def test_page_totals(spark):
    rows = facets.facet_page(docs(spark), "id", 1, 3).collect()
    assert [(r.id, r.total, r.pages) for r in rows] == [(4, 4, 2)]


def test_highlight(spark):
    row = docs(spark).where("id = 3").select(facets.highlight(F.col("text"), "(gamma) be").alias("h")).collect()[0]
    assert row.h == "<b>be</b>ta <b>(gamma)</b>"


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "node string, dep string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_closures_with_a_cycle(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("z", "y"))
    assert {r.id for r in lineage.transitive_dependencies(e, ids(spark, "d")).collect()} == {"a", "b", "c"}
    assert {r.id for r in lineage.transitive_dependencies(e, ids(spark, "a")).collect()} == {"b", "c"}
    assert {r.id for r in lineage.transitive_successors(e, ids(spark, "a")).collect()} == {"b", "c", "d"}
    got = {tuple(r) for r in lineage.table_lineage(e, ids(spark, "d")).collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")}


@pytest.fixture
def rounds(monkeypatch):
    """Nodes found in each round of the closures that are walked."""
    counts, kept = [], lineage._kept

    def counted(df, path):
        out, n = kept(df, path)
        if "found-" in path:
            counts.append(n)
        return out, n

    monkeypatch.setattr(lineage, "_kept", counted)
    return counts


def test_a_chain_takes_logarithmic_rounds(spark, rounds):
    e = edges(spark, *((f"n{i}", f"n{i + 1}") for i in range(999)))
    assert lineage.transitive_dependencies(e, ids(spark, "n0")).count() == 999
    assert len(rounds) <= 13 and sum(rounds) == 1000  # the start and the empty round included


def test_a_cycle_and_a_ladder_take_logarithmic_rounds(spark, rounds):
    cycle = [(f"c{i}", f"c{(i + 1) % 200}") for i in range(200)]
    ladder = [(f"{a}{i}", f"{b}{i + 1}") for i in range(200) for a in "lr" for b in "lr"]
    e = edges(spark, *cycle, *ladder, ("c7", "l0"))
    assert lineage.transitive_dependencies(e, ids(spark, "c3")).count() == 199 + 401
    assert lineage.transitive_successors(e, ids(spark, "r200")).count() == 200 + 400
    assert len(rounds) <= 2 * 13


def test_a_wide_graph_needs_a_round_per_step(spark, rounds):
    """Three ways at every step: nothing is doubled, nothing is lost."""
    wide = [(f"{a}{i}", f"{b}{i + 1}") for i in range(6) for a in "xyz" for b in "xyz"]
    assert lineage.transitive_dependencies(edges(spark, *wide), ids(spark, "x0")).count() == 18
    assert len(rounds) == 8


def test_closures_against_brute_force(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)})
    start = "n1"
    seen, todo = {start}, [start]
    while todo:
        node = todo.pop()
        for a, b in pairs:
            if a == node and b not in seen:
                seen.add(b)
                todo.append(b)
    got = {r.id for r in lineage.upstream(edges(spark, *pairs), ids(spark, start)).collect()}
    assert got == seen


def test_field_lineage_directions(spark):
    e = edges(spark, ("b.x", "a.x"), ("c.x", "b.x"))
    got = {tuple(r) for r in lineage.field_lineage(e, ids(spark, "b.x")).collect()}
    assert got == {("backward", "b.x", "a.x"), ("forward", "b.x", "c.x")}


def test_blackbox_lineage(spark):
    fields = spark.createDataFrame([("v", "a"), ("v", "b"), ("d", "x"), ("d", "y"), ("w", "p"), ("w", "q")], "view string, field string")
    table_edges = spark.createDataFrame([("v", "d"), ("w", "d")], "view string, dep_view string")
    explicit = spark.createDataFrame([("w", "p", "d", "x")], "view string, field string, dep_view string, dep_field string")
    got = {tuple(r) for r in lineage.blackbox_lineage(fields, table_edges, explicit).collect()}
    assert got == {
        ("v", "a", "d", "x"), ("v", "a", "d", "y"), ("v", "b", "d", "x"), ("v", "b", "d", "y"),
        ("d", "x", "d", "x"), ("d", "y", "d", "y"), ("w", "p", "d", "x"),
    }


def test_catalog_edges(spark):
    df = spark.createDataFrame(
        [("v", {"d": ["d/1", "d/2"]}, {"a": ["v.a", "d.x"]})],
        "name string, dependencies map<string,array<string>>, lineage map<string,array<string>>",
    )
    got = {tuple(r) for r in lineage.catalog_edges(df).collect()}
    assert got == {("table", "v", "d"), ("partition", "v", "d/1"), ("partition", "v", "d/2"), ("field", "v.a", "d.x")}


def test_sequential_rows(spark):
    schema = spark.createDataFrame([], "id string, n int, b boolean, d date, s struct<x:int,y:string>, l array<int>, m map<string,int>").schema
    rows = fixtures.sequential_rows(spark, schema, 3).collect()
    r = sorted(rows, key=lambda x: x.n)[1]
    assert (r.id, r.n, r.b, r.d, tuple(r.s), r.l, r.m) == (
        "id-0001", 1, False, "1970-01-01T00:00:01.000Z", (1, "y-0001"), [], {},
    )


def test_fill_missing(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    given = spark.createDataFrame([(0, "x", ["a"]), (1, None, ["a"]), (2, None, [])], "i int, a string, given array<string>")
    rows = fixtures.fill_missing(given, schema, "given", F.col("i")).collect()
    assert [tuple(r) for r in rows] == [("x", 0), (None, 1), ("a-0002", 2)]
    rows = fixtures.fill_missing(given, schema, "given", F.col("i"), null_fields=True).collect()
    assert [tuple(r) for r in rows] == [("x", None), (None, None), (None, None)]


def test_table_diff(spark):
    schema = "a int, b string"
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], schema)
    right = spark.createDataFrame([(1, "x"), (2, None), (4, "w")], schema)
    got = {tuple(r) for r in fixtures.table_diff(left, right).collect()}
    assert got == {(1, "x", 2, 1), (3, "z", 1, 0), (4, "w", 0, 1)}
    assert fixtures.table_diff(left, left).count() == 0
    keyed = {(r.a, r.status) for r in fixtures.table_diff_by_key(left.distinct(), right, ["a"]).collect()}
    assert keyed == {(3, "missing"), (4, "unexpected")}


@pytest.mark.parametrize(
    "values, expected", [([2], [1]), ([2, None], []), ([], [None, 1, 2]), ([2, 2, 9], [1])]
)
def test_not_in_treats_nulls_as_sql_does(spark, values, expected):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    other = spark.createDataFrame([(v,) for v in values], "y int")
    df.createOrReplaceTempView("not_in_left")
    other.createOrReplaceTempView("not_in_right")
    sql = spark.sql("SELECT x FROM not_in_left WHERE x NOT IN (SELECT y FROM not_in_right)")
    got = sorted((r.x for r in not_in(df, "x", other).collect()), key=str)
    assert got == sorted((r.x for r in sql.collect()), key=str) == sorted(expected, key=str)


def test_a_page_reads_the_ranges_that_hold_it(spark, tmp_path):
    rows = spark.range(1_000).select(F.format_string("p%05d", F.col("id") * 7919 % 1_000).alias("partition"), F.create_map(F.lit("k"), "id").alias("m"))
    ties = spark.range(5).select(F.lit("p00500").alias("partition"), F.create_map(F.lit("t"), "id").alias("m"))
    rows = rows.unionByName(ties).unionByName(spark.createDataFrame([(None, None)], "partition string, m map<string,bigint>"))
    directory = profile.PageDirectory.write(rows, str(tmp_path / "pages"), ranges=20)
    assert len(directory.ranges) == 20 and directory.ranges[-1][2] == 1_006
    pages = [[r.partition for r in directory.page(n, 97).collect()] for n in range(11)]
    assert [len(p) for p in pages] == [97] * 10 + [36]
    assert sum(pages, [])[0] is None and sum(pages, [])[1:] == sorted(r.partition for r in rows.collect() if r.partition)
    assert directory.page(11, 97).collect() == [] and directory.page(5, 97).collect() == directory.page(5, 97).collect()
    plan = directory.page(5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    none = profile.PageDirectory.write(rows.limit(0), str(tmp_path / "none"), ranges=3)
    assert none.page(0, 10).collect() == [] and none.page(0, 10).columns == ["partition", "m"]
