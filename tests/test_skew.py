"""A third of all rows on one key: joins are split and groups shrink before the shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewforge.model import Field, ViewDef
from viewforge.operators import lineage
from viewforge.operators.collect import collect_map
from viewforge.operators.joins import not_in, optional_join
from viewforge.operators.partitions import select_partitions
from viewforge.plans import osm, shop
from viewforge.plans.transform import scoped_settings
from viewforge.sources.formats import read_view, write_view

ROWS = 300_000
JOB = {"created_at": "a", "created_by": "b"}

# Thresholds small enough for the rows above; broadcasts off, as for large tables.
SETTINGS = {
    "spark.sql.shuffle.partitions": "48",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
}


@pytest.fixture
def small_thresholds(spark):
    with scoped_settings(spark, SETTINGS):
        yield


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skew") / "base")
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20000 + 1)
    spark.range(ROWS).select(
        "id", key.alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.md5(F.col("id").cast("string")).alias("text")
    ).repartition(12).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df):
    """Number of rows, and the plan as adaptive execution left it."""
    execution = df._jdf.queryExecution()
    rows = execution.toRdd().count()
    return rows, execution.executedPlan().toString()


def test_shop_profiles(small_thresholds, base):
    shops = base.select(
        F.col("id").cast("string").alias("id"),
        F.col("text").alias("shop_name"),
        F.col("v").alias("shop_type"),
        F.col("k").cast("string").alias("area"),
    )
    rows, plan = final_plan(osm.shop_profiles(shops, shops, shops, JOB))
    assert rows == ROWS and "skew=true" in plan


def test_tagged_nodes(small_thresholds, base):
    nodes = base.select(
        F.col("k").alias("id"),
        F.lit(1).alias("version"),
        F.lit(1).alias("user_id"),
        F.col("text").alias("tstamp"),
        F.lit(1.0).alias("longitude"),
        F.lit(2.0).alias("latitude"),
        F.lit("g").alias("geohash"),
    )
    tags = base.select(F.col("k").alias("node_id"), F.col("v").alias("key"), F.col("text").alias("value"))
    rows, plan = final_plan(osm.tagged_nodes(nodes, tags))
    assert rows == ROWS and "skew=true" in plan


def test_product_brand(small_thresholds, base):
    products = base.select("id", F.col("text").alias("occurred_at"), F.col("k").alias("brand_id"))
    brands = base.groupBy(F.col("k").alias("id"), F.length("v").alias("n")).agg(F.min("v").alias("brand_name")).drop("n")
    rows, plan = final_plan(shop.product_brand(products, brands))
    assert rows == ROWS and "skew=true" in plan


def test_not_in(small_thresholds, base):
    values = base.where("k > 0").select("k")
    rows, plan = final_plan(not_in(base.select("k", "text"), "k", values))
    assert rows == ROWS // 3 and "skew=true" in plan


def test_optional_join(small_thresholds, spark, base):
    """The hot key is on the side that may be missing; two kept rows have no partner."""
    kept = base.select("k").distinct().unionByName(spark.createDataFrame([(-1,), (None,)], "k long")).toDF("kept")
    joined = optional_join(kept, base.select("k", "text"), "kept", "k")
    rows, plan = final_plan(joined)
    assert rows == ROWS + 2 and "skew=true" in plan
    plain = kept.join(base.select("k", "text"), F.col("kept") == F.col("k"), "left")
    assert joined.columns == plain.columns
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_a_hot_wanted_partition(small_thresholds, base):
    wanted = base.where("k < 5000").select("k")
    rows, plan = final_plan(select_partitions(base.select("k", "text"), wanted))
    assert rows == base.where("k < 5000").count() and "skew=true" in plan


def test_semi_join_by_distinct_keys(small_thresholds, base):
    """The right side of a semi join sends one row per key and task."""
    base.createOrReplaceTempView("skewed")
    rows, plan = final_plan(
        base.sparkSession.sql(
            "SELECT k FROM (SELECT DISTINCT k FROM skewed) a WHERE EXISTS "
            "(SELECT 1 FROM (SELECT DISTINCT k AS hot FROM skewed WHERE v < '3') b WHERE b.hot = a.k)"
        )
    )
    assert rows == base.where("v < '3'").select("k").distinct().count()
    assert plan.count("HashAggregate") >= 4


def test_blackbox_lineage(small_thresholds, spark, base):
    """A view with very many fields takes one field from each of two others; the rest stand for themselves."""
    fields = base.select(F.col("k").alias("view"), F.col("text").alias("field"))
    edges = spark.createDataFrame([(0, -1), (0, -2), (0, -3)], "view long, dep_view long")
    other = spark.createDataFrame([(-1, "f"), (-2, "f")], "view long, field string")
    rows, _ = final_plan(lineage.blackbox_lineage(fields.unionByName(other), edges))
    assert rows == 2 * (ROWS // 3) + (ROWS - ROWS // 3) + 2


def test_collect_map_sends_one_row_per_key_and_task(small_thresholds, base):
    maps = collect_map(base, ["k"], "v", "text").collect()
    hot = next(r for r in maps if r.k == 0)
    assert len(hot.tags) == 7


def test_a_hot_partition_is_written_by_many_tasks(small_thresholds, spark, base, tmp_path):
    view = ViewDef("Hot", [Field("id", "bigint"), Field("text", "string")], partitions=[Field("p", "int")])
    rows = base.select("id", "text", F.when(F.col("k") == 0, 0).otherwise(F.col("k") % 20 + 1).cast("int").alias("p"))
    with scoped_settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k"}):
        write_view(rows, view, str(tmp_path / "t"))
    assert read_view(spark, view, str(tmp_path / "t")).count() == ROWS
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert files["p=0"] > 3 and max(n for name, n in files.items() if name != "p=0") <= files["p=0"]
