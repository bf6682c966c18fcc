"""Profiling, catalogue, facet and lineage queries, and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge_queries.common import table
from viewforge.functions.dates import month_id, month_text, year_text
from viewforge.operators import facets, fixtures, lineage, partitions, profile
from viewforge.operators.facets import Facet
from viewforge.session import scratch_path

# ---------------------------------------------------------------- profiles


def _rounded(df):
    """Means and sums of doubles depend on the order of addition in the last digits."""
    return df.select(
        *(
            F.round(F.col(c), 2).alias(c) if c.endswith(("__avg", "__stddev", "__sum")) and df.schema[c].dataType.typeName() == "double" else F.col(c)
            for c in df.columns
        )
    )


def profile_lineitem(spark, sf_dir):
    return _rounded(profile.profile_table(table(spark, sf_dir, "lineitem")))


def profile_flags(spark, sf_dir):
    """Booleans, sometimes null, and collections."""
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "click", F.col("value") > 20).alias("high"),
        F.split("props", ":").alias("pieces"),
        "event_type",
    )
    return profile.profile_table(rows)


def profile_embeddings(spark, sf_dir):
    """Sizes of the arrays beside the numbers."""
    return _rounded(profile.profile_table(table(spark, sf_dir, "embeddings")))


def profile_customer(spark, sf_dir):
    return _rounded(profile.profile_table(table(spark, sf_dir, "customer")))


def profile_long(spark, sf_dir):
    """Every metric of every column; those of fractions as texts of two digits after the point."""
    long = profile.profile_long(table(spark, sf_dir, "lineitem"), "db.lineitem")
    fraction = F.col("metric").rlike("__(avg|stddev)$|^l_(quantity|extendedprice|discount|tax)__")
    return long.withColumn("value", F.when(fraction, F.format_string("%.2f", F.col("value").cast("double"))).otherwise(F.col("value")))


# ---------------------------------------------------------------- partitions of orders


def _orders(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").withColumns({"year": year_text(at), "month": month_text(at), "month_id": month_id(at)})


def _partitions(spark, sf_dir):
    """One row per month and status: its text, newest key as time, state."""
    rows = _orders(spark, sf_dir).groupBy("year", "month", "o_orderstatus").agg(
        F.max("o_orderkey").alias("ts"), F.count(F.lit(1)).alias("n")
    )
    return rows.select(
        "year",
        "month",
        F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("view"),
        F.concat(F.lit("year="), "year", F.lit("/month="), "month", F.lit("/status="), "o_orderstatus").alias("partition"),
        "ts",
        F.when(F.col("n") % 4 == 0, "materialized")
        .when(F.col("n") % 4 == 1, "failed")
        .when(F.col("n") % 4 == 2, "waiting")
        .otherwise("transforming")
        .alias("status"),
        (F.col("n") % 3 == 0).alias("incomplete"),
        (F.col("n") % 5 == 0).alias("with_errors"),
    )


def sample_partition(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "year", "month")
    return profile.sample_partition(rows, {"year": "1997", "month": "05"}, ["o_orderkey"])


def partition_stats(spark, sf_dir):
    stats = profile.partition_stats(_orders(spark, sf_dir), ["year", "month"], "o_orderdate")
    return stats.withColumn("last_change", F.date_format("last_change", "yyyy-MM-dd HH:mm:ss"))


def partition_sizes(spark, sf_dir):
    """File listings of a table written by year; sizes depend on the codec, so only their presence is compared."""
    path = scratch_path(spark, "partition_sizes")
    _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "year").write.partitionBy("year").parquet(path)
    sizes = profile.partition_sizes(spark, path, ["year"])
    return sizes.select("year", (F.col("n_bytes") > 0).alias("has_bytes"), (F.col("n_files") > 0).alias("has_files"))


def table_last_transformation(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), F.col("c_custkey")).alias("table_name"), (F.col("c_nationkey") * -1).cast("long").alias("ts")
    )
    parts = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey")).alias("table_name"), F.col("o_orderkey").alias("ts")
    )
    return profile.table_last_transformation(customers, parts)


def parameter_values(spark, sf_dir):
    values = profile.parameter_values(_partitions(spark, sf_dir))
    return values.select("parameter", F.array_join("vals", ",").alias("vals"))


def distinct_parameters(spark, sf_dir):
    """Each partition text lists its parameters by position."""
    rows = _partitions(spark, sf_dir).select(F.posexplode(F.split("partition", "/")).alias("position", "pair"))
    return profile.distinct_parameters(rows.select("position", F.substring_index("pair", "=", 1).alias("name")))


def distinct_owners(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return profile.distinct_owners(documents.select(F.nullif("source", F.lit("src3")).alias("owner")))


def top_tables(spark, sf_dir):
    views = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("table_name")).agg(
        F.count(F.lit(1)).alias("view_count")
    )
    return profile.top_tables(views)


def latest_activities(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("activity_id"), "ts", "event_type")
    latest = profile.latest_activities(events)
    return latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def partition_page(spark, sf_dir):
    return profile.partition_page(_partitions(spark, sf_dir), 2, 15).select("partition", "view", "ts")


def partition_page_directory(spark, sf_dir):
    """A page of all orders by the directory of their ranges."""
    directory = profile.PageDirectory.write(table(spark, sf_dir, "orders"), scratch_path(spark, "pages"), "o_orderkey", ranges=16)
    return directory.page(20, 50)


def partition_position(spark, sf_dir):
    return profile.partition_position(_partitions(spark, sf_dir), "year=1998/month=03/status=O")


def status_overview(spark, sf_dir):
    return profile.status_overview(_partitions(spark, sf_dir))


def status_details(spark, sf_dir):
    return profile.status_details(_partitions(spark, sf_dir))


def status_filter(spark, sf_dir):
    wanted = partitions.expand_partitions(spark, ["rym(199701-199912)"], ["year", "month"], earliest="1995-01-01")
    rows = profile.status_filter(
        _partitions(spark, sf_dir), wanted=wanted, name_regex="orders_[of]", issue="incomplete AND errors"
    )
    return rows.select("view", "partition", "status")


def status_filter_state(spark, sf_dir):
    return profile.status_filter(_partitions(spark, sf_dir), status="failed", issue="errors").select("view", "partition")


# ---------------------------------------------------------------- facets

FACETS = [Facet("lang", "OR", exclude_own=True), Facet("source"), Facet("tags", "AND")]
SELECTED = {"lang": ["en", "fr"], "tags": ["even", "long"]}


def _documents(spark, sf_dir):
    tags = F.array_compact(
        F.array(
            F.when(F.col("doc_id") % 2 == 0, "even"),
            F.when(F.col("n_chars") > 1000, "long"),
            F.when(F.col("doc_id") % 3 == 0, "third"),
        )
    )
    return table(spark, sf_dir, "documents").withColumn("tags", tags)


def facet_search_terms(spark, sf_dir):
    return facets.facet_search_terms(_documents(spark, sf_dir), ["text", "source"], "The src1 on").select("doc_id", "source")


def facet_filter(spark, sf_dir):
    return facets.facet_filter(_documents(spark, sf_dir), FACETS, SELECTED).select("doc_id", "lang", "n_chars")


def facet_counts(spark, sf_dir):
    return facets.facet_counts(_documents(spark, sf_dir), FACETS, SELECTED)


def facet_hour_ranges(spark, sf_dir):
    return facets.facet_hour_ranges(
        table(spark, sf_dir, "events"), F.col("ts"), F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    )


def facet_page(spark, sf_dir):
    hits = facets.facet_filter(_documents(spark, sf_dir), FACETS, {"lang": ["en"]})
    return facets.facet_page(hits.select("doc_id", "source"), "doc_id", 3, 12)


def highlight_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(facets.highlight(F.col("text"), "the on")).alias("marked"))


def categories_grouped(spark, sf_dir):
    """Brands as tables; types and sizes as taxonomies."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select(
        F.col("p_brand").alias("table_name"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("type").alias("taxonomy"), F.col("p_type").alias("category"),
                    F.substring("p_type", 1, 3).alias("category_object"),
                ),
                F.struct(
                    F.lit("size").alias("taxonomy"), (F.col("p_size") % 5).cast("string").alias("category"),
                    F.col("p_size").cast("string").alias("category_object"),
                ),
            )
        ),
    )
    grouped = facets.categories_grouped(rows)
    return grouped.select(
        "table_name", "taxonomy", F.array_join("categories", ",").alias("categories"),
        F.array_join("category_objects", ",").alias("category_objects"),
    )


# ---------------------------------------------------------------- lineage


def part_edges(spark, sf_dir):
    """Part tables built from the parts with a third and a seventh of their number, and from one supplier table."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    part = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return parts.select(
        part(key).alias("node"),
        F.explode(
            F.array(
                part(F.floor(key / 3)),
                part(F.floor(key / 7)),
                F.concat(F.lit("s"), (key % 10).cast("string")),
            )
        ).alias("dep"),
    ).where(F.col("node") != F.col("dep")).distinct()


PART_START = "p20"


def _start(spark, sf_dir):
    """The start table as it stands in the edges."""
    return part_edges(spark, sf_dir).where(F.col("node") == PART_START).select(F.col("node").alias("id")).distinct()


def table_lineage(spark, sf_dir):
    return lineage.table_lineage(part_edges(spark, sf_dir), _start(spark, sf_dir))


def field_lineage(spark, sf_dir):
    return lineage.field_lineage(part_edges(spark, sf_dir), _start(spark, sf_dir))


def transitive_dependencies(spark, sf_dir):
    return lineage.transitive_dependencies(part_edges(spark, sf_dir), _start(spark, sf_dir))


def transitive_successors(spark, sf_dir):
    return lineage.transitive_successors(part_edges(spark, sf_dir), _start(spark, sf_dir))


def _fields(spark, sf_dir):
    """Orders as views, their line numbers as fields."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("view"), F.col("l_linenumber").alias("field")).distinct()


def _view_edges(spark, sf_dir):
    """An order depends on the order with a fifth of its number; finished orders depend on nothing."""
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") != "F")
        .select(key.alias("view"), F.floor(key / 5).alias("dep_view"), "o_orderstatus")
        .where(F.col("view") != F.col("dep_view"))
    )


def _explicit(spark, sf_dir):
    """Partly filled orders declare line 1 to come from line 2 of their dependency."""
    return (
        _view_edges(spark, sf_dir)
        .where(F.col("o_orderstatus") == "P")
        .select("view", F.lit(1).alias("field"), "dep_view", F.lit(2).alias("dep_field"))
    )


def declared_lineage(spark, sf_dir):
    return lineage.declared_lineage(_explicit(spark, sf_dir), _fields(spark, sf_dir))


def blackbox_lineage(spark, sf_dir):
    return lineage.blackbox_lineage(_fields(spark, sf_dir), _view_edges(spark, sf_dir), _explicit(spark, sf_dir))


def _field_edges(spark, sf_dir):
    """Parts per supplier: table, field, and the table and field they come from."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 7).cast("string")).alias("node_table"),
        F.concat(F.lit("f"), (F.col("l_linenumber")).cast("string")).alias("node_field"),
        F.concat(F.lit("u"), (F.col("l_partkey") % 11).cast("string")).alias("dep_table"),
        F.concat(F.lit("g"), (F.col("l_partkey") % 20).cast("string")).alias("dep_field"),
    )


def field_dependencies_grouped(spark, sf_dir):
    grouped = lineage.field_dependencies_grouped(_field_edges(spark, sf_dir), "t3")
    return grouped.withColumn("other_fields", F.array_join("other_fields", ","))


def field_successors_grouped(spark, sf_dir):
    grouped = lineage.field_successors_grouped(_field_edges(spark, sf_dir), "u5")
    return grouped.withColumn("other_fields", F.array_join("other_fields", ","))


def catalog_edges(spark, sf_dir):
    """Orders as nested view descriptions: customers as tables, states as partitions, keys as fields."""
    orders = table(spark, sf_dir, "orders")
    customer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    name = F.concat(F.lit("o"), (F.col("o_orderkey") % 1000).cast("string"))
    rows = orders.select(
        name.alias("name"),
        F.create_map(customer, F.array(F.concat(customer, F.lit("/"), "o_orderstatus"))).alias("dependencies"),
        F.create_map(
            F.lit("key"), F.array(F.concat(customer, F.lit(".key")), F.concat(name, F.lit(".key")))
        ).alias("lineage"),
    )
    return lineage.catalog_edges(rows)


# ---------------------------------------------------------------- generated rows


def sequential_rows(spark, sf_dir):
    """As many generated rows as there are customers, with the columns of that table."""
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        *fixtures.sequential_columns(customers.schema, F.col("c_custkey").cast("long")),
        fixtures.sequential_value("seen", T.DateType(), F.col("c_custkey")).alias("seen"),
        fixtures.sequential_value("flag", T.BooleanType(), F.col("c_custkey")).alias("flag"),
    )


def fill_missing(spark, sf_dir):
    """Some suppliers give their name, which may be null; the rest is generated."""
    rows = table(spark, sf_dir, "supplier")
    given = rows.select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("s_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("s_suppkey"), F.lit("s_name")))
        .otherwise(F.array(F.lit("s_suppkey")))
        .alias("given"),
    )
    return fixtures.fill_missing(given, rows.schema, "given", F.col("s_suppkey"))


def table_diff(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("BUILDING").alias("segment"))
    return fixtures.table_diff(customers, suppliers.toDF("c_nationkey", "c_mktsegment"))


def table_diff_by_key(spark, sf_dir):
    """The second table lacks low priorities and has urgent orders, which the first lacks; large ones have a new status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_orderkey", F.lit("X").alias("new_status"))
    expected = orders.where(F.col("o_orderpriority") != "1-URGENT")
    actual = (
        orders.where(F.col("o_orderpriority") != "5-LOW")
        .join(large, "o_orderkey", "left")
        .withColumn("o_orderstatus", F.coalesce("new_status", "o_orderstatus"))
    )
    return fixtures.table_diff_by_key(expected, actual, ["o_orderkey"]).select("o_orderkey", "status")


QUERIES = {
    "profile_table": profile_lineitem,
    "profile_table_flags": profile_flags,
    "profile_table_customer": profile_customer,
    "profile_table_embeddings": profile_embeddings,
    "profile_long": profile_long,
    "sample_partition": sample_partition,
    "partition_stats": partition_stats,
    "partition_sizes": partition_sizes,
    "table_last_transformation": table_last_transformation,
    "parameter_values": parameter_values,
    "distinct_parameters": distinct_parameters,
    "distinct_owners": distinct_owners,
    "top_tables": top_tables,
    "latest_activities": latest_activities,
    "partition_page": partition_page,
    "partition_page_directory": partition_page_directory,
    "partition_position": partition_position,
    "status_overview": status_overview,
    "status_details": status_details,
    "status_filter": status_filter,
    "status_filter_state": status_filter_state,
    "facet_search_terms": facet_search_terms,
    "facet_filter": facet_filter,
    "facet_counts": facet_counts,
    "facet_hour_ranges": facet_hour_ranges,
    "facet_page": facet_page,
    "highlight_terms": highlight_terms,
    "categories_grouped": categories_grouped,
    "table_lineage": table_lineage,
    "field_lineage": field_lineage,
    "transitive_dependencies": transitive_dependencies,
    "transitive_successors": transitive_successors,
    "declared_lineage": declared_lineage,
    "blackbox_lineage": blackbox_lineage,
    "field_dependencies_grouped": field_dependencies_grouped,
    "field_successors_grouped": field_successors_grouped,
    "catalog_edges": catalog_edges,
    "sequential_rows": sequential_rows,
    "fill_missing": fill_missing,
    "table_diff": table_diff,
    "table_diff_by_key": table_diff_by_key,
}


def _numeric_metrics(column: str, whole: bool) -> str:
    total = f"CAST(SUM({column}) AS BIGINT)" if whole else f"ROUND(SUM({column}), 2)"
    return (
        f"MIN({column}) AS {column}__min, MAX({column}) AS {column}__max, ROUND(AVG({column}), 2) AS {column}__avg, "
        f"ROUND(STDDEV_POP({column}), 2) AS {column}__stddev, {total} AS {column}__sum"
    )


def _text_metrics(column: str) -> str:
    return f"MIN({column}) AS {column}__min, MAX({column}) AS {column}__max"


LINE_WHOLE, LINE_FRACTIONS = ["orderkey", "partkey", "suppkey", "linenumber"], ["quantity", "extendedprice", "discount", "tax"]
LINE_TEXTS = ["returnflag", "linestatus"]
LINE_METRICS = [
    *(_numeric_metrics(f"l_{c}", True) for c in LINE_WHOLE),
    *(_numeric_metrics(f"l_{c}", False) for c in LINE_FRACTIONS),
    *(_text_metrics(f"l_{c}") for c in LINE_TEXTS),
]
_LONG_METRICS = [
    ("agg_rows", "COUNT(*)::VARCHAR"),
    *((f"l_{c}__{m}", f"{m}(l_{c})::VARCHAR") for c in LINE_WHOLE + LINE_TEXTS for m in ("min", "max")),
    *((f"l_{c}__sum", f"sum(l_{c})::VARCHAR") for c in LINE_WHOLE),
    *((f"l_{c}__{m}", f"printf('%.2f', {m}(l_{c})::DOUBLE)") for c in LINE_FRACTIONS for m in ("min", "max", "sum")),
    *((f"l_{c}__avg", f"printf('%.2f', avg(l_{c}))") for c in LINE_WHOLE + LINE_FRACTIONS),
    *((f"l_{c}__stddev", f"printf('%.2f', stddev_pop(l_{c}))") for c in LINE_WHOLE + LINE_FRACTIONS),
]
PROFILE_LONG_SQL = (
    "SELECT 'db.lineitem.' || metric AS id, 'db.lineitem' AS fqdn, metric, value FROM (SELECT UNNEST(["
    + ", ".join(f"'{name}'" for name, _ in _LONG_METRICS)
    + "]) AS metric, UNNEST(["
    + ", ".join(sql for _, sql in _LONG_METRICS)
    + "]) AS value FROM lineitem) m"
)
PARTITIONS_SQL = (
    "(SELECT *, 'orders_' || lower(status) AS view, 'year=' || year || '/month=' || month || '/status=' || status AS partition, "
    "CASE n % 4 WHEN 0 THEN 'materialized' WHEN 1 THEN 'failed' WHEN 2 THEN 'waiting' ELSE 'transforming' END AS state, "
    "n % 3 = 0 AS incomplete, n % 5 = 0 AS with_errors FROM "
    "(SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, o_orderstatus AS status, "
    "MAX(o_orderkey) AS ts, COUNT(*) AS n FROM orders GROUP BY 1, 2, 3) o)"
)
DOCUMENTS_SQL = (
    "(SELECT *, doc_id % 2 = 0 AS even, n_chars > 1000 AS long, doc_id % 3 = 0 AS third FROM documents)"
)
EDGES_SQL = (
    "edges AS (SELECT DISTINCT node, dep FROM (SELECT 'p' || p_partkey AS node, UNNEST(['p' || (p_partkey // 3), "
    "'p' || (p_partkey // 7), 's' || (p_partkey % 10)]) AS dep FROM part) e WHERE node <> dep)"
)
UP_SQL = f"up AS (SELECT '{PART_START}' AS id UNION SELECT dep FROM edges JOIN up ON node = id)"
DOWN_SQL = f"down AS (SELECT '{PART_START}' AS id UNION SELECT node FROM edges JOIN down ON dep = id)"
FIELDS_SQL = (
    "fields AS (SELECT DISTINCT l_orderkey AS view, l_linenumber AS field FROM lineitem), "
    "view_edges AS (SELECT o_orderkey AS view, o_orderkey // 5 AS dep_view, o_orderstatus AS status FROM orders "
    "WHERE o_orderstatus <> 'F' AND o_orderkey <> o_orderkey // 5), "
    "explicit AS (SELECT view, 1 AS field, dep_view, 2 AS dep_field FROM view_edges WHERE status = 'P')"
)
FIELD_EDGES_SQL = (
    "(SELECT DISTINCT 't' || (l_suppkey % 7) AS node_table, 'f' || l_linenumber AS node_field, "
    "'u' || (l_partkey % 11) AS dep_table, 'g' || (l_partkey % 20) AS dep_field FROM lineitem)"
)
CATALOG_SQL = (
    "(SELECT 'o' || (o_orderkey % 1000) AS name, 'c' || o_custkey AS customer, o_orderstatus AS status FROM orders)"
)

ORACLE = {
    "profile_table": f"SELECT COUNT(*) AS agg_rows, {', '.join(LINE_METRICS)} FROM lineitem",
    "profile_table_flags": "SELECT COUNT(*) AS agg_rows, COUNT(*) FILTER (high) AS high__true, "
    "COUNT(*) FILTER (high IS NOT TRUE) AS high__false, CAST(MIN(LEN(pieces)) AS INT) AS pieces__min, "
    f"CAST(MAX(LEN(pieces)) AS INT) AS pieces__max, {_text_metrics('event_type')} FROM (SELECT "
    "CASE WHEN event_type <> 'click' THEN value > 20 END AS high, string_split(props, ':') AS pieces, event_type FROM events) e",
    "profile_table_customer": f"SELECT COUNT(*) AS agg_rows, {_numeric_metrics('c_custkey', True)}, {_text_metrics('c_name')}, "
    f"{_numeric_metrics('c_nationkey', True)}, {_numeric_metrics('c_acctbal', False)}, {_text_metrics('c_mktsegment')} FROM customer",
    "profile_table_embeddings": f"SELECT COUNT(*) AS agg_rows, {_numeric_metrics('vec_id', True)}, "
    "CAST(MIN(LEN(embedding)) AS INT) AS embedding__min, CAST(MAX(LEN(embedding)) AS INT) AS embedding__max, "
    f"{_numeric_metrics('label', True)} FROM embeddings",
    "profile_long": PROFILE_LONG_SQL,
    "sample_partition": "SELECT o_orderkey, o_custkey, '1997' AS year, '05' AS month FROM orders "
    "WHERE strftime(o_orderdate, '%Y%m') = '199705' ORDER BY o_orderkey LIMIT 10",
    "partition_stats": "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, COUNT(*) AS n_rows, "
    "strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_change FROM orders GROUP BY 1, 2",
    "partition_sizes": "SELECT DISTINCT strftime(o_orderdate, '%Y') AS year, true AS has_bytes, true AS has_files FROM orders",
    "table_last_transformation": "SELECT 't' || c_custkey AS table_name, CAST(COALESCE(m, -c_nationkey) AS BIGINT) AS last_transformation "
    "FROM customer LEFT JOIN (SELECT o_custkey, MAX(o_orderkey) AS m FROM orders GROUP BY 1) o ON o_custkey = c_custkey",
    "parameter_values": "SELECT parameter, string_agg(v, ',' ORDER BY first_text, v) AS vals FROM (SELECT parameter, v, "
    "MIN(text) AS first_text FROM (SELECT partition AS text, UNNEST(['year', 'month', 'status']) AS parameter, "
    f"UNNEST([year, month, status]) AS v FROM {PARTITIONS_SQL} p) x GROUP BY 1, 2) y GROUP BY parameter",
    "distinct_parameters": "SELECT name, CAST(MAX(position) AS INT) AS max_position FROM (SELECT UNNEST(['year', 'month', 'status']) "
    f"AS name, UNNEST([0, 1, 2]) AS position FROM {PARTITIONS_SQL} p) x GROUP BY name",
    "distinct_owners": "SELECT DISTINCT source AS owner FROM documents WHERE source <> 'src3'",
    "top_tables": "SELECT source AS table_name, COUNT(*) AS view_count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "latest_activities": "SELECT activity_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type FROM "
    "(SELECT event_id AS activity_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10) e",
    "partition_page": f"SELECT partition, view, ts FROM {PARTITIONS_SQL} p ORDER BY partition LIMIT 15 OFFSET 30",
    "partition_page_directory": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000",
    "partition_position": f"SELECT COUNT(*) AS position FROM {PARTITIONS_SQL} p WHERE partition < 'year=1998/month=03/status=O'",
    "status_overview": f"SELECT state AS status, COUNT(*) AS n_partitions FROM {PARTITIONS_SQL} p GROUP BY state",
    "status_details": f"SELECT view, state AS status, COUNT(*) AS n_partitions, MAX(ts) AS newest FROM {PARTITIONS_SQL} p GROUP BY view, state",
    "status_filter": f"SELECT view, partition, state AS status FROM {PARTITIONS_SQL} p WHERE year BETWEEN '1997' AND '1999' "
    "AND view IN ('orders_o', 'orders_f') AND state IN ('materialized', 'failed') AND incomplete AND with_errors",
    "status_filter_state": f"SELECT view, partition FROM {PARTITIONS_SQL} p WHERE state = 'failed' AND with_errors",
    "facet_search_terms": "SELECT doc_id, source FROM documents WHERE contains(lower(text || ' ' || source), 'the') "
    "AND contains(lower(text || ' ' || source), 'src1') AND contains(lower(text || ' ' || source), 'on')",
    "facet_filter": f"SELECT doc_id, lang, n_chars FROM {DOCUMENTS_SQL} d WHERE lang IN ('en', 'fr') AND even AND long",
    "facet_counts": f"SELECT 'lang' AS facet, lang AS value, COUNT(*) AS n FROM {DOCUMENTS_SQL} d WHERE even AND long GROUP BY lang "
    f"UNION ALL SELECT 'source', source, COUNT(*) FROM {DOCUMENTS_SQL} d WHERE even AND long AND lang IN ('en', 'fr') GROUP BY source "
    f"UNION ALL SELECT 'tags', tag, COUNT(*) FROM (SELECT UNNEST(list_filter([CASE WHEN even THEN 'even' END, "
    f"CASE WHEN long THEN 'long' END, CASE WHEN third THEN 'third' END], lambda x: x IS NOT NULL)) AS tag FROM {DOCUMENTS_SQL} d "
    "WHERE even AND long AND lang IN ('en', 'fr')) t GROUP BY tag",
    "facet_hour_ranges": "SELECT "
    + ", ".join(
        f"COUNT(*) FILTER (ts <= TIMESTAMP '2024-01-25 12:00:00'"
        + (f" AND ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL {h} HOUR" if h else "")
        + f") AS {n}"
        for n, h in facets.HOUR_RANGES.items()
    )
    + " FROM events",
    "facet_page": "SELECT doc_id, source, (SELECT COUNT(*) FROM documents WHERE lang = 'en') AS total, "
    "(SELECT CAST(CEIL(COUNT(*) / 12.0) AS BIGINT) FROM documents WHERE lang = 'en') AS pages FROM documents "
    "WHERE lang = 'en' ORDER BY doc_id LIMIT 12 OFFSET 36",
    "highlight_terms": "SELECT doc_id, md5(regexp_replace(text, '(?i)(the|on)', '<b>\\1</b>', 'g')) AS marked FROM documents",
    "categories_grouped": "SELECT p_brand AS table_name, 'type' AS taxonomy, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories, "
    "string_agg(DISTINCT substr(p_type, 1, 3), ',' ORDER BY substr(p_type, 1, 3)) AS category_objects FROM part GROUP BY p_brand "
    "UNION ALL SELECT p_brand, 'size', string_agg(DISTINCT CAST(p_size % 5 AS VARCHAR), ',' ORDER BY CAST(p_size % 5 AS VARCHAR)), "
    "string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) FROM part GROUP BY p_brand",
    "table_lineage": f"WITH RECURSIVE {EDGES_SQL}, {UP_SQL}, {DOWN_SQL} SELECT DISTINCT dep AS from_table, node AS to_table "
    "FROM edges WHERE node IN (SELECT id FROM up) OR dep IN (SELECT id FROM down)",
    "field_lineage": f"WITH RECURSIVE {EDGES_SQL}, {UP_SQL}, {DOWN_SQL} SELECT 'backward' AS direction, node AS from_field, "
    "dep AS to_field FROM edges WHERE node IN (SELECT id FROM up) UNION ALL SELECT 'forward', dep, node FROM edges "
    "WHERE dep IN (SELECT id FROM down)",
    "transitive_dependencies": f"WITH RECURSIVE {EDGES_SQL}, {UP_SQL} SELECT id FROM up WHERE id <> '{PART_START}'",
    "transitive_successors": f"WITH RECURSIVE {EDGES_SQL}, {DOWN_SQL} SELECT id FROM down WHERE id <> '{PART_START}'",
    "declared_lineage": f"WITH {FIELDS_SQL} SELECT e.* FROM explicit e SEMI JOIN fields f ON e.view = f.view AND e.field = f.field",
    "blackbox_lineage": f"WITH {FIELDS_SQL}, open AS (SELECT * FROM fields WHERE view NOT IN (SELECT view FROM explicit)) "
    "SELECT o.view, o.field, f.view AS dep_view, f.field AS dep_field FROM open o JOIN view_edges e ON e.view = o.view "
    "JOIN fields f ON f.view = e.dep_view UNION ALL "
    "SELECT view, field, view, field FROM open WHERE view NOT IN (SELECT view FROM view_edges) UNION ALL "
    "SELECT e.view, e.field, e.dep_view, e.dep_field FROM explicit e SEMI JOIN fields f ON e.view = f.view AND e.field = f.field",
    "field_dependencies_grouped": "SELECT node_field AS field, dep_table AS other_table, "
    f"string_agg(dep_field, ',' ORDER BY dep_field) AS other_fields FROM {FIELD_EDGES_SQL} e WHERE node_table = 't3' GROUP BY 1, 2",
    "field_successors_grouped": "SELECT field, other_table, string_agg(other_field, ',' ORDER BY other_field) AS other_fields FROM "
    "(SELECT DISTINCT dep_field AS field, node_table AS other_table, node_field AS other_field "
    f"FROM {FIELD_EDGES_SQL} e WHERE dep_table = 'u5') x GROUP BY 1, 2",
    "catalog_edges": f"SELECT DISTINCT 'table' AS kind, name AS from_id, customer AS to_id FROM {CATALOG_SQL} c UNION ALL "
    f"SELECT DISTINCT 'partition', name, customer || '/' || status FROM {CATALOG_SQL} c UNION ALL "
    f"SELECT DISTINCT 'field', name || '.key', customer || '.key' FROM {CATALOG_SQL} c",
    "sequential_rows": "SELECT c_custkey, 'c_name-' || printf('%04d', c_custkey) AS c_name, CAST(c_custkey AS INT) AS c_nationkey, "
    "CAST(c_custkey AS DOUBLE) AS c_acctbal, 'c_mktsegment-' || printf('%04d', c_custkey) AS c_mktsegment, "
    "strftime(make_timestamp(c_custkey * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS seen, c_custkey % 2 = 0 AS flag FROM customer",
    "fill_missing": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN s_name "
    "ELSE 's_name-' || printf('%04d', s_suppkey) END AS s_name, CAST(s_suppkey AS INT) AS s_nationkey, "
    "CAST(s_suppkey AS DOUBLE) AS s_acctbal FROM supplier",
    "table_diff": "SELECT COALESCE(a.k, b.k) AS c_nationkey, COALESCE(a.s, b.s) AS c_mktsegment, COALESCE(a.n, 0) AS n_expected, "
    "COALESCE(b.n, 0) AS n_actual FROM (SELECT c_nationkey AS k, c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY 1, 2) a "
    "FULL JOIN (SELECT s_nationkey AS k, 'BUILDING' AS s, COUNT(*) AS n FROM supplier GROUP BY 1, 2) b ON a.k = b.k AND a.s = b.s "
    "WHERE COALESCE(a.n, 0) <> COALESCE(b.n, 0)",
    "table_diff_by_key": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'unexpected' WHEN '5-LOW' THEN 'missing' "
    "ELSE 'changed' END AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') OR o_totalprice > 450000",
}
