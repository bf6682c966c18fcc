"""The worked pipelines on the fixture rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewforge.functions.geo import geohash
from viewforge.operators.collect import collect_map
from viewforge.plans import osm

JOB = {"created_at": "2024-05-01T10:00:00.000Z", "created_by": "test"}

STAGE = [
    (122317, 7, 50299, "2014-09-17T13:49:26Z", 10.0232716, 53.5282633),
    (122318, 6, 50299, "2013-06-17 15:49:26Z", 10.0243161, 53.5297589),
]
TAGS = [
    (122317, "TMC:cid_58:tabcd_1:Class", "Point"),
    (122318, "TMC:cid_58:tabcd_1:Direction", "positive"),
    (122318, "TMC:cid_58:tabcd_1:LCLversion", "8.00"),
    (122318, "TMC:cid_58:tabcd_1:LocationCode", "10696"),
]


def stage_nodes(spark):
    return spark.createDataFrame(STAGE, osm.STAGE_NODES.schema)


def test_geohash_of_swapped_and_ordered_coordinates(spark):
    nodes = osm.nodes_with_geohash(stage_nodes(spark)).orderBy("id")
    assert [r.geohash for r in nodes.collect()] == ["t1y140djfcq0", "t1y140g5vgcn"]
    ordered = stage_nodes(spark).select(geohash(F.col("latitude"), F.col("longitude")).alias("g")).collect()
    assert ordered[0].g == "u1x0s0d8xpt0"


def test_geohash_bounds_and_precision(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0)], "lat double, lon double")
    rows = df.select(*(geohash(F.col("lat"), F.col("lon"), p).alias(f"p{p}") for p in (1, 5, 12))).collect()
    assert rows[0].p12 == "z" * 12 and rows[1].p12 == "0" * 12
    assert (len(rows[0].p1), len(rows[0].p5)) == (1, 5)


def test_stage_reads_tab_separated_files(spark, tmp_path):
    (tmp_path / "nodes.txt").write_text("122317\t7\t50299\t2014-09-17T13:49:26Z\t10.0232716\t53.5282633\n")
    row = osm.stage(spark, osm.STAGE_NODES, str(tmp_path)).collect()[0]
    assert (row.id, row.version, row.longitude) == (122317, 7, 10.0232716)


def test_nodes_of_a_month(spark):
    nodes = osm.nodes_with_geohash(stage_nodes(spark))
    tags = spark.createDataFrame(TAGS, osm.STAGE_NODE_TAGS.schema)
    rows = osm.processed_nodes(nodes, tags, "2013", "06", JOB).collect()
    assert len(rows) == 1
    assert rows[0].id == "122318"
    assert rows[0].occurred_at == "2013-06-17 15:49:26Z"
    assert (rows[0].version, rows[0].user_id, rows[0].month_id) == (6, 50299, "201306")
    assert rows[0].tags == {
        "TMC:cid_58:tabcd_1:Direction": "positive",
        "TMC:cid_58:tabcd_1:LCLversion": "8.00",
        "TMC:cid_58:tabcd_1:LocationCode": "10696",
    }


def test_repeated_nodes_collapse_and_untagged_nodes_vanish(spark):
    nodes = osm.nodes_with_geohash(stage_nodes(spark).unionAll(stage_nodes(spark)))
    tags = spark.createDataFrame(TAGS[:1], osm.STAGE_NODE_TAGS.schema)
    assert [r.id for r in osm.tagged_nodes(nodes, tags).collect()] == [122317]


def processed(spark, rows):
    return spark.createDataFrame(rows, "id string, geohash string, tags map<string,string>")


def test_shops(spark):
    nodes = processed(
        spark,
        [
            ("122317", "t1y140djfcq0", {"name": "Netto", "shop": "supermarket"}),
            ("274850441", "t1y87ki9fcq0", {"name": "Schanzenbaeckerei", "shop": "bakery"}),
            ("279023080", "t1y77d8jfcq0", {"name": "Edeka Linow", "shop": "supermarket"}),
            ("279023080", "t1y77d8jfcq0", {"name": "Edeka Linow"}),
        ],
    )
    rows = sorted((r.id, r.shop_name, r.shop_type, r.area) for r in osm.shops(nodes, JOB).collect())
    assert rows == [
        ("122317", "Netto", "supermarket", "t1y140d"),
        ("274850441", "Schanzenbaeckerei", "bakery", "t1y87ki"),
        ("279023080", "Edeka Linow", "supermarket", "t1y77d8"),
    ]


def test_restaurants_and_trainstations(spark):
    nodes = processed(
        spark,
        [
            ("1", "t1y06x1aaaaa", {"name": "Cuore Mio", "cuisine": "italian", "amenity": "restaurant"}),
            ("2", "t1y140dbbbbb", {"name": "Hagenbecks Tierpark", "railway": "station"}),
            ("3", "t1y87kiccccc", {"name": "Boenningstedt", "railway": "halt"}),
            ("4", "t1y87kiccccc", {"name": "Depot", "railway": "yard", "amenity": "pub"}),
        ],
    )
    assert [(r.id, r.restaurant_type, r.area) for r in osm.restaurants(nodes, JOB).collect()] == [
        ("1", "italian", "t1y06x1")
    ]
    stations = osm.trainstations(nodes, JOB)
    assert sorted((r.id, r.area) for r in stations.collect()) == [("2", "t1y140d"), ("3", "t1y87ki")]
    assert stations.columns == ["id", "station_name", "area", "created_at", "created_by"]


def test_shop_profiles(spark):
    shops = spark.createDataFrame(
        [
            ("122546", "Netto", "supermarket", "t1y87ki"),
            ("274850441", "Schanzenbaeckerei", "bakery", "t1y87ki"),
            ("279023080", "Edeka Linow", "supermarket", "t1y77d8"),
        ],
        "id string, shop_name string, shop_type string, area string",
    )
    restaurants = spark.createDataFrame(
        [("267622930", "t1y06x1"), ("288858596", "t1y87ki"), ("302281521", "t1y17m9")], "id string, area string"
    )
    stations = spark.createDataFrame([("122317", "t1y140d"), ("122317", "t1y87ki")], "id string, area string")
    rows = {r.id: r for r in osm.shop_profiles(shops, restaurants, stations, JOB).collect()}
    assert len(rows) == 3
    netto = rows["122546"]
    assert (netto.cnt_competitors, netto.cnt_restaurants, netto.cnt_trainstations) == (1, 1, 1)
    edeka = rows["279023080"]
    assert (edeka.cnt_competitors, edeka.cnt_restaurants, edeka.cnt_trainstations) == (0, 0, 0)


def test_a_shop_without_area_is_kept(spark):
    shops = spark.createDataFrame([("1", "a", "b", None)], "id string, shop_name string, shop_type string, area string")
    empty = spark.createDataFrame([], "id string, area string")
    row = osm.shop_profiles(shops, empty, empty, JOB).collect()[0]
    assert (row.area, row.cnt_competitors) == (None, 0)


def test_collect_map_has_a_defined_winner(spark):
    rows = spark.createDataFrame(
        [("u", "k", "old", 1), ("u", "k", "new", 2), ("u", None, "x", 3), ("v", "k", None, 1)],
        "g string, key string, value string, at int",
    )
    maps = {r.g: r.tags for r in collect_map(rows, ["g"], "key", "value", order_by="at").collect()}
    assert maps == {"u": {"k": "new"}, "v": {"k": None}}
