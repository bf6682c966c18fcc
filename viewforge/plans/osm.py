"""The map data pipeline: stage files, geohashes, tags, places, shop profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.functions.geo import geohash
from viewforge.model import CREATED_AT, CREATED_BY, ID, MONTHLY, OCCURRED_AT, Csv, Field, ViewDef
from viewforge.operators.collect import collect_map
from viewforge.operators.joins import SPREAD, group_for_join
from viewforge.operators.views import conform, with_job_metadata
from viewforge.sources.files import read_tsv

STAGE_NODES = ViewDef(
    "Nodes",
    [
        Field("id", "bigint"),
        Field("version", "int"),
        Field("userId", "int"),
        Field("tstamp", "string"),
        Field("longitude", "double"),
        Field("latitude", "double"),
    ],
    package="osm.stage",
    storage=Csv(separator="\t"),
)
STAGE_NODE_TAGS = ViewDef(
    "NodeTags",
    [Field("nodeId", "bigint"), Field("key", "string"), Field("value", "string")],
    package="osm.stage",
    storage=Csv(separator="\t"),
)
NODES = ViewDef(
    "Nodes",
    [
        ID,
        OCCURRED_AT,
        Field("version", "int"),
        Field("userId", "int"),
        Field("longitude", "double"),
        Field("latitude", "double"),
        Field("geohash", "string"),
        Field("tags", "map<string,string>"),
        CREATED_AT,
        CREATED_BY,
    ],
    package="osm.processed",
    partitions=MONTHLY,
)
RESTAURANTS = ViewDef(
    "Restaurants",
    [
        ID,
        Field("restaurantName", "string"),
        Field("restaurantType", "string"),
        Field("area", "string"),
        CREATED_AT,
        CREATED_BY,
    ],
    package="osm.datahub",
)
SHOPS = ViewDef(
    "Shops",
    [ID, Field("shopName", "string"), Field("shopType", "string"), Field("area", "string"), CREATED_AT, CREATED_BY],
    package="osm.datahub",
)
TRAINSTATIONS = ViewDef(
    "Trainstations",
    [ID, Field("stationName", "string"), Field("area", "string"), CREATED_AT, CREATED_BY],
    package="osm.datahub",
)
SHOP_PROFILES = ViewDef(
    "ShopProfiles",
    [
        ID,
        Field("shopName", "string"),
        Field("shopType", "string"),
        Field("area", "string"),
        Field("cntCompetitors", "int"),
        Field("cntRestaurants", "int"),
        Field("cntTrainstations", "int"),
        CREATED_AT,
        CREATED_BY,
    ],
    package="osm.datamart",
)

AREA_LENGTH = 7
NODE_COLUMNS = ["id", "tstamp", "version", "user_id", "longitude", "latitude", "geohash"]


def stage(spark: SparkSession, view: ViewDef, path: str) -> DataFrame:
    return read_tsv(spark, view, path)


def nodes_with_geohash(nodes: DataFrame) -> DataFrame:
    """Stage nodes with their geohash. The example swaps the coordinates; its results need that."""
    return nodes.withColumn("geohash", geohash(F.col("longitude"), F.col("latitude")))


def tagged_nodes(nodes: DataFrame, node_tags: DataFrame) -> DataFrame:
    """Nodes that have tags, each with its tag map.

    Both sides shrink before the join: tags are folded to one row per node and
    repeated node rows collapse, each with partial results on the map side.
    Nothing after the join needs its partitioning, so adaptive execution may
    split a node id that still has very many rows.
    """
    tags = collect_map(node_tags, ["node_id"], "key", "value")
    single = nodes.select(*NODE_COLUMNS).distinct()
    return single.join(tags, single["id"] == tags["node_id"]).drop("node_id")


def nodes_of_month(nodes: DataFrame, node_tags: DataFrame, year: str, month: str) -> DataFrame:
    """The processed nodes of one month, month numbers compared as numbers."""
    at = F.col("tstamp").cast("timestamp")
    in_month = nodes.where((F.year(at) == int(year)) & (F.month(at) == int(month)))
    return tagged_nodes(in_month, node_tags)


def processed_nodes(
    nodes: DataFrame, node_tags: DataFrame, year: str, month: str, job: Mapping[str, str]
) -> DataFrame:
    rows = nodes_of_month(nodes, node_tags, year, month)
    named = rows.withColumnRenamed("tstamp", "occurred_at").withColumns(
        {"year": F.lit(year), "month": F.lit(month), "month_id": F.lit(year + month)}
    )
    return conform(with_job_metadata(named, **job), NODES)


def area(geohash_column: Column) -> Column:
    return F.substring(geohash_column, 1, AREA_LENGTH)


def _tag(name: str) -> Column:
    return F.col("tags").getItem(name)


def restaurants(nodes: DataFrame, job: Mapping[str, str]) -> DataFrame:
    found = nodes.where(_tag("amenity") == "restaurant").select(
        "id",
        _tag("name").alias("restaurant_name"),
        _tag("cuisine").alias("restaurant_type"),
        area(F.col("geohash")).alias("area"),
    )
    return conform(with_job_metadata(found, **job), RESTAURANTS)


def shops(nodes: DataFrame, job: Mapping[str, str]) -> DataFrame:
    """Nodes with a shop tag, whatever its value."""
    found = nodes.where(_tag("shop").like("%")).select(
        "id",
        _tag("name").alias("shop_name"),
        _tag("shop").alias("shop_type"),
        area(F.col("geohash")).alias("area"),
    )
    return conform(with_job_metadata(found, **job), SHOPS)


def trainstations(nodes: DataFrame, job: Mapping[str, str]) -> DataFrame:
    found = nodes.where(_tag("railway").isin("station", "halt")).select(
        "id", _tag("name").alias("station_name"), area(F.col("geohash")).alias("area")
    )
    return conform(with_job_metadata(found, **job), TRAINSTATIONS)


def counts_by_area(shop_rows: DataFrame, restaurant_rows: DataFrame, station_rows: DataFrame) -> DataFrame:
    """How many places of each kind lie in each area.

    The three tables are tagged, stacked and counted in one aggregation, so
    partial counts rather than rows are shuffled and a hot area costs one row
    per task.
    """

    def tagged(rows: DataFrame, kind: str) -> DataFrame:
        return rows.where(F.col("id").isNotNull()).select("area", F.lit(kind).alias("kind"))

    stacked = (
        tagged(shop_rows, "shop")
        .unionByName(tagged(restaurant_rows, "restaurant"))
        .unionByName(tagged(station_rows, "station"))
    )
    counts = group_for_join(stacked.where(F.col("area").isNotNull()), ["area"]).agg(
        F.count_if(F.col("kind") == "shop").alias("n_shops"),
        F.count_if(F.col("kind") == "restaurant").alias("n_restaurants"),
        F.count_if(F.col("kind") == "station").alias("n_stations"),
    )
    return counts.drop(SPREAD)


def shop_profiles(
    shop_rows: DataFrame, restaurant_rows: DataFrame, station_rows: DataFrame, job: Mapping[str, str]
) -> DataFrame:
    """Every shop with the number of competitors, restaurants and stations in its area."""
    counts = counts_by_area(shop_rows, restaurant_rows, station_rows)

    def count_or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0)).cast("int")

    profiled = shop_rows.join(counts, "area", "left").select(
        "id",
        "shop_name",
        "shop_type",
        "area",
        count_or_zero(F.col("n_shops") - 1).alias("cnt_competitors"),
        count_or_zero(F.col("n_restaurants")).alias("cnt_restaurants"),
        count_or_zero(F.col("n_stations")).alias("cnt_trainstations"),
    )
    return conform(with_job_metadata(profiled, **job), SHOP_PROFILES)

