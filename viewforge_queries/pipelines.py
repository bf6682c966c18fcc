"""The worked pipelines over tables derived from the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewforge_queries.common import table
from viewforge.functions.digests import digest, digest_groups
from viewforge.functions.geo import geohash
from viewforge.operators.collect import collect_map
from viewforge.plans import osm, shop
from viewforge.session import scratch_path

JOB = {"created_at": "2024-05-01T10:00:00.000Z", "created_by": "nightly"}
JOB_SQL = "'2024-05-01T10:00:00.000Z' AS created_at, 'nightly' AS created_by"


def stage_nodes(spark, sf_dir):
    """Events as map nodes: coordinates follow from the event number."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.lit(1).alias("version"),
        F.col("user_id").cast("int").alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("tstamp"),
        ((F.col("event_id") * 7919 % 36000) / 100 - 180).alias("longitude"),
        ((F.col("event_id") * 104729 % 18000) / 100 - 90).alias("latitude"),
    )


def stage_tags(spark, sf_dir):
    """Event types as shop, amenity and railway tags, and the number in ``props`` as a name."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    tags = F.array(
        F.struct(F.lit("type").alias("key"), kind.alias("value")),
        F.struct(F.lit("name").alias("key"), k.alias("value")),
        F.struct(F.when(kind == "purchase", "shop").alias("key"), k.alias("value")),
        F.struct(F.when(kind == "view", "amenity").alias("key"), F.lit("restaurant").alias("value")),
        F.struct(F.when(kind == "signup", "railway").alias("key"), F.lit("halt").alias("value")),
    )
    rows = table(spark, sf_dir, "events").where(kind != "error")
    return rows.select(F.col("event_id").alias("node_id"), F.inline(tags)).where(F.col("key").isNotNull())


def osm_stage(spark, sf_dir):
    path = scratch_path(spark, "osm_stage")
    stage_nodes(spark, sf_dir).write.csv(path, sep="\t")
    return osm.stage(spark, osm.STAGE_NODES, path)


def osm_geohash(spark, sf_dir):
    """The hash as the pipeline makes it, with swapped coordinates, and the ordinary one."""
    nodes = osm.nodes_with_geohash(stage_nodes(spark, sf_dir))
    return nodes.select("id", "geohash", geohash(F.col("latitude"), F.col("longitude"), 7).alias("ordinary"))


def collect_map_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id"
    )
    folded = collect_map(events, ["user_id"], "event_type", "k", order_by="event_id", name="last_k")
    return folded.select("user_id", _map_text("last_k").alias("last_k"))


def _map_text(column: str):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def osm_nodes(spark, sf_dir):
    nodes = osm.nodes_with_geohash(stage_nodes(spark, sf_dir))
    rows = osm.processed_nodes(nodes, stage_tags(spark, sf_dir), "2024", "01", JOB)
    return rows.withColumn("tags", _map_text("tags"))


def _processed(spark, sf_dir):
    return osm.tagged_nodes(osm.nodes_with_geohash(stage_nodes(spark, sf_dir)), stage_tags(spark, sf_dir)).withColumn(
        "id", F.col("id").cast("string")
    )


def osm_shops(spark, sf_dir):
    return osm.shops(_processed(spark, sf_dir), JOB)


def osm_restaurants(spark, sf_dir):
    return osm.restaurants(_processed(spark, sf_dir), JOB)


def osm_trainstations(spark, sf_dir):
    return osm.trainstations(_processed(spark, sf_dir), JOB)


def osm_shop_profiles(spark, sf_dir):
    """Customers as shops, suppliers as restaurants, customers in debt as stations; nations as areas."""
    customers = table(spark, sf_dir, "customer")
    area = F.col("c_nationkey").cast("string").alias("area")
    shop_rows = customers.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("shop_name"),
        F.col("c_mktsegment").alias("shop_type"),
        area,
    )
    restaurant_rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("area")
    )
    station_rows = customers.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), area)
    return osm.shop_profiles(shop_rows, restaurant_rows, station_rows, JOB)


def product_brand(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    products = parts.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("2014-10-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("occurred_at"),
        F.col("p_brand").alias("brand_id"),
        F.concat(F.lit("201410"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("date_id"),
    )
    brands = parts.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_name").alias("brand_name"))
    return shop.product_brand(products, brands, "20141007")


def _clicks(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "click")
        .select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("/page/"), F.get_json_object("props", "$.k")).alias("url"),
            F.concat(F.lit("EC"), F.lpad((F.col("user_id") % 5).cast("string"), 2, "0")).alias("shop_code"),
        )
    )


def clicks_of_shop(spark, sf_dir):
    return shop.clicks_of_shop(_clicks(spark, sf_dir), "EC03")


def clicks_group_min(spark, sf_dir):
    return shop.clicks_group_min(_clicks(spark, sf_dir))


def digest_rows(spark, sf_dir):
    """The digest of several texts of one row, as for the texts that make up a declaration."""
    orders = table(spark, sf_dir, "orders")
    texts = F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return orders.select(
        "o_orderkey", digest(texts).alias("checksum"), digest(F.array().cast("array<string>")).alias("empty")
    )


def digest_groups_query(spark, sf_dir):
    """One digest per month over all its orders, whatever their number and order; orders of Octobers have no text."""
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    orders = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("month_id"), F.when(F.month("o_orderdate") != 10, text).alias("text")
    )
    return digest_groups(orders, ["month_id"], "text")


QUERIES = {
    "osm_stage": osm_stage,
    "osm_geohash": osm_geohash,
    "collect_map": collect_map_query,
    "osm_nodes": osm_nodes,
    "osm_shops": osm_shops,
    "osm_restaurants": osm_restaurants,
    "osm_trainstations": osm_trainstations,
    "osm_shop_profiles": osm_shop_profiles,
    "product_brand": product_brand,
    "clicks_of_shop": clicks_of_shop,
    "clicks_group_min": clicks_group_min,
    "digest_rows": digest_rows,
    "digest_groups": digest_groups_query,
}

NODES_SQL = (
    "SELECT event_id AS id, 1 AS version, CAST(user_id AS INT) AS user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tstamp, "
    "(event_id * 7919 % 36000) / 100 - 180 AS longitude, (event_id * 104729 % 18000) / 100 - 90 AS latitude FROM events"
)
TAGS_SQL = (
    "SELECT node_id, key, value FROM (SELECT event_id AS node_id, UNNEST([{'key': 'type', 'value': event_type}, "
    "{'key': 'name', 'value': props->>'$.k'}, "
    "{'key': CASE WHEN event_type = 'purchase' THEN 'shop' END, 'value': props->>'$.k'}, "
    "{'key': CASE WHEN event_type = 'view' THEN 'amenity' END, 'value': 'restaurant'}, "
    "{'key': CASE WHEN event_type = 'signup' THEN 'railway' END, 'value': 'halt'}], recursive := true) "
    "FROM events WHERE event_type <> 'error') t WHERE key IS NOT NULL"
)


def _geohash_sql(latitude: str, longitude: str, precision: int) -> str:
    """Bit by bit: even bits from the longitude, odd bits from the latitude."""
    characters = []
    for position in range(precision):
        bits = []
        for offset in range(5):
            bit = 5 * position + offset
            axis = "lon_cell" if bit % 2 == 0 else "lat_cell"
            bits.append(f"(({axis} >> {29 - bit // 2}) & 1) * {1 << (4 - offset)}")
        characters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} + 1 AS INT), 1)")
    cells = (
        f"LEAST(CAST(FLOOR(({latitude} + 90) / 180 * 1073741824.0) AS BIGINT), 1073741823) AS lat_cell, "
        f"LEAST(CAST(FLOOR(({longitude} + 180) / 360 * 1073741824.0) AS BIGINT), 1073741823) AS lon_cell"
    )
    return f"SELECT *, {' || '.join(characters)} AS hash FROM (SELECT *, {cells} FROM nodes) c"


def _hash_columns(latitude: str, longitude: str, precision: int, name: str) -> str:
    return f"(SELECT id, hash AS {name} FROM ({_geohash_sql(latitude, longitude, precision)}) h)"


# Clamped like the library does: the swapped call hands longitudes to the latitude axis.
SWAPPED = _hash_columns("GREATEST(LEAST(longitude, 90), -90)", "latitude", 12, "geohash")
ORDINARY = _hash_columns("latitude", "longitude", 7, "ordinary")

WITH_NODES = f"WITH nodes AS ({NODES_SQL}), tags AS ({TAGS_SQL}), swapped AS {SWAPPED}"

FOLDED = (
    f"{WITH_NODES}, folded AS (SELECT node_id, MAP_FROM_ENTRIES(LIST((key, value))) AS tags, "
    "string_agg(key || '=' || value, ',' ORDER BY key) AS tag_text FROM tags GROUP BY node_id), "
    "processed AS (SELECT n.*, s.geohash, f.tags, f.tag_text FROM nodes n JOIN swapped s ON n.id = s.id "
    "JOIN folded f ON n.id = f.node_id)"
)
CLICKS_SQL = (
    "(SELECT event_id AS id, '/page/' || (props->>'$.k') AS url, 'EC' || lpad(CAST(user_id % 5 AS VARCHAR), 2, '0') "
    "AS shop_code FROM events WHERE event_type = 'click')"
)
DAY_OF_PART = "lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0')"

ORACLE = {
    "osm_stage": NODES_SQL,
    "osm_geohash": f"WITH nodes AS ({NODES_SQL}) SELECT s.id, s.geohash, o.ordinary FROM {SWAPPED} s JOIN {ORDINARY} o ON s.id = o.id",
    "collect_map": "SELECT user_id, string_agg(event_type || '=' || k, ',' ORDER BY event_type) AS last_k FROM "
    "(SELECT user_id, event_type, arg_max(props->>'$.k', event_id) AS k FROM events GROUP BY 1, 2) e GROUP BY user_id",
    "osm_nodes": f"{FOLDED} SELECT CAST(id AS VARCHAR) AS id, tstamp AS occurred_at, version, user_id, longitude, latitude, "
    f"geohash, tag_text AS tags, {JOB_SQL}, '2024' AS year, '01' AS month, '202401' AS month_id FROM processed "
    "WHERE tstamp LIKE '2024-01-%'",
    "osm_shops": f"{FOLDED} SELECT CAST(id AS VARCHAR) AS id, tags['name'] AS shop_name, tags['shop'] AS shop_type, "
    f"substr(geohash, 1, 7) AS area, {JOB_SQL} FROM processed WHERE tags['shop'] IS NOT NULL",
    "osm_restaurants": f"{FOLDED} SELECT CAST(id AS VARCHAR) AS id, tags['name'] AS restaurant_name, "
    f"tags['cuisine'] AS restaurant_type, substr(geohash, 1, 7) AS area, {JOB_SQL} FROM processed "
    "WHERE tags['amenity'] = 'restaurant'",
    "osm_trainstations": f"{FOLDED} SELECT CAST(id AS VARCHAR) AS id, tags['name'] AS station_name, "
    f"substr(geohash, 1, 7) AS area, {JOB_SQL} FROM processed WHERE tags['railway'] IN ('station', 'halt')",
    "osm_shop_profiles": "SELECT CAST(c.c_custkey AS VARCHAR) AS id, c.c_name AS shop_name, c.c_mktsegment AS shop_type, "
    "CAST(c.c_nationkey AS VARCHAR) AS area, CAST(COALESCE(a.n, 0) AS INT) AS cnt_competitors, "
    "CAST(COALESCE(b.n, 0) AS INT) AS cnt_restaurants, CAST(COALESCE(d.n, 0) AS INT) AS cnt_trainstations, "
    f"{JOB_SQL} FROM customer c "
    "LEFT JOIN (SELECT c_nationkey AS area, COUNT(*) - 1 AS n FROM customer GROUP BY 1) a ON a.area = c.c_nationkey "
    "LEFT JOIN (SELECT s_nationkey AS area, COUNT(*) AS n FROM supplier GROUP BY 1) b ON b.area = c.c_nationkey "
    "LEFT JOIN (SELECT c_nationkey AS area, COUNT(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) d "
    "ON d.area = c.c_nationkey",
    "product_brand": f"SELECT '2014-10-' || {DAY_OF_PART} AS occurred_at, p_partkey AS product_id, b.brand_name FROM part p "
    "JOIN (SELECT p_brand, MIN(p_name) AS brand_name FROM part GROUP BY 1) b ON b.p_brand = p.p_brand "
    f"WHERE '201410' || {DAY_OF_PART} = '20141007'",
    "clicks_of_shop": f"SELECT id, url FROM {CLICKS_SQL} c WHERE shop_code = 'EC03'",
    "clicks_group_min": f"SELECT url, shop_code, MIN(id) AS min_id FROM {CLICKS_SQL} c GROUP BY url, shop_code",
    "digest_rows": "SELECT o_orderkey, upper(md5(array_to_string(list_sort([o_orderstatus, o_orderpriority, "
    "CAST(o_custkey AS VARCHAR)]), ''))) AS checksum, '0' AS empty FROM orders",
    "digest_groups": "SELECT month_id, COUNT(h) AS n_texts, CASE WHEN COUNT(h) = 0 THEN '0' ELSE upper(md5(COUNT(h) || '-' || "
    "SUM(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) || '-' || SUM(CAST('0x' || substr(h, 17, 16) AS UBIGINT)))) END AS digest "
    "FROM (SELECT strftime(o_orderdate, '%Y%m') AS month_id, "
    "CASE WHEN MONTH(o_orderdate) <> 10 THEN md5(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) END AS h "
    "FROM orders) o GROUP BY month_id",
}
