"""SQL clauses, each as one query over whole tables.

Where one text runs in both engines it is written once; otherwise the second
text of an entry is the comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from viewforge_queries.common import run_sql, table, with_views
from viewforge.operators.joins import not_in, optional_join
from viewforge.session import scratch_path

# Monthly sums per priority: a small, bounded input for window functions, so a
# hot priority never puts its rows into one window task.
MONTHLY = """
SELECT o_orderpriority AS priority, CAST(YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS INT) AS ym,
       CAST(COUNT(*) AS BIGINT) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
FROM orders GROUP BY o_orderpriority, YEAR(o_orderdate) * 100 + MONTH(o_orderdate)
"""

CLAUSES: dict[str, tuple] = {
    "q_select": (
        ["orders"],
        "SELECT ALL o_orderkey, o_custkey AS customer, o_totalprice * 2 AS double_price, o_orderstatus FROM orders AS o",
    ),
    "q_distinct": (["orders"], "SELECT DISTINCT o_custkey, o_orderpriority FROM orders"),
    "q_where": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
        "WHERE l_quantity > 45 AND l_discount >= 0.05 AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'",
    ),
    "q_in": (
        ["orders", "customer"],
        "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_custkey IN "
        "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    ),
    "q_between": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem "
        "WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.08",
    ),
    "q_like": (
        ["part"],
        "SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%ring%' AND p_type NOT LIKE 'STANDARD%'",
    ),
    # The inner keys are made distinct on the map side: the right side of a semi
    # join is not split, however many rows one key has.
    "q_exists": (
        ["customer", "orders"],
        "SELECT c_custkey, c_name FROM customer c WHERE EXISTS "
        "(SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) o "
        "WHERE o.o_custkey = c.c_custkey)",
        "SELECT c_custkey, c_name FROM customer c WHERE EXISTS "
        "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    ),
    "q_is": (
        ["events"],
        "SELECT event_id, flag IS NULL AS is_null, flag IS NOT NULL AS not_null, flag IS TRUE AS is_true, "
        "flag IS NOT TRUE AS not_true, flag IS FALSE AS is_false, flag IS NOT FALSE AS not_false, "
        "flag IS UNKNOWN AS is_unknown FROM "
        "(SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value > 20 END AS flag FROM events) e",
        "SELECT event_id, flag IS NULL AS is_null, flag IS NOT NULL AS not_null, flag IS TRUE AS is_true, "
        "flag IS NOT TRUE AS not_true, flag IS FALSE AS is_false, flag IS NOT FALSE AS not_false, "
        "flag IS NULL AS is_unknown FROM "
        "(SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value > 20 END AS flag FROM events) e",
    ),
    "q_null_safe": (
        ["orders"],
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') IS DISTINCT FROM 'F' AS differs, "
        "NULLIF(o_orderstatus, 'P') IS NOT DISTINCT FROM NULLIF(o_orderstatus, 'O') AS same FROM orders",
    ),
    "q_compare": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_partkey = l_suppkey AS eq, l_partkey <> l_suppkey AS ne, "
        "l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge, "
        "l_returnflag != 'A' AS ne2 FROM lineitem",
    ),
    "q_arith": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS added, l_partkey - l_suppkey AS taken, "
        "l_quantity * 2 AS doubled, l_quantity / 4 AS quarter, l_partkey % 7 AS rest, l_partkey DIV 7 AS whole, "
        "-l_suppkey AS negative, +l_suppkey AS positive FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS added, l_partkey - l_suppkey AS taken, "
        "l_quantity * 2 AS doubled, l_quantity / 4 AS quarter, l_partkey % 7 AS rest, l_partkey // 7 AS whole, "
        "-l_suppkey AS negative, +l_suppkey AS positive FROM lineitem",
    ),
    "q_concat": (["customer"], "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer"),
    "q_logic": (
        ["orders"],
        "SELECT o_orderkey, o_orderstatus = 'O' AND o_totalprice > 100000 AS both_true, "
        "o_orderstatus = 'O' OR o_totalprice > 100000 AS one_true, NOT o_orderstatus = 'O' AS negated "
        "FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 1000)",
    ),
    "q_case": (
        ["orders"],
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'part' END AS status, "
        "CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS size_class FROM orders",
    ),
    "q_inner_join": (
        ["orders", "customer"],
        "SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c "
        "ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 10",
    ),
    "q_full_join": (
        ["supplier", "customer"],
        "SELECT s.nation AS supplier_nation, c.nation AS customer_nation, s.n AS suppliers, c.n AS customers FROM "
        "(SELECT s_nationkey AS nation, COUNT(*) AS n FROM supplier WHERE s_acctbal > 7000 GROUP BY s_nationkey) s "
        "FULL OUTER JOIN "
        "(SELECT c_nationkey AS nation, COUNT(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) c "
        "ON s.nation = c.nation",
    ),
    "q_semi_join": (
        ["orders", "customer"],
        "SELECT c_custkey, c_name FROM customer c LEFT SEMI JOIN "
        "(SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON c.c_custkey = o.o_custkey",
        "SELECT c_custkey, c_name FROM customer c SEMI JOIN orders o "
        "ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'",
    ),
    # The right side is one row: a global aggregate.
    "q_cross_join": (
        ["orders"],
        "SELECT o_orderkey, o_totalprice > average AS above FROM orders CROSS JOIN "
        "(SELECT CAST(AVG(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS average FROM orders) a",
    ),
    "q_natural_join": (
        ["customer", "nation"],
        "SELECT nationkey, c_custkey, n_name FROM "
        "(SELECT c_custkey, c_nationkey AS nationkey FROM customer) c NATURAL JOIN "
        "(SELECT n_nationkey AS nationkey, n_name FROM nation) n",
    ),
    "q_using_join": (
        ["orders", "lineitem"],
        "SELECT orderkey, l_linenumber, l_partkey, o_orderstatus FROM "
        "(SELECT o_orderkey AS orderkey, o_orderstatus FROM orders) o JOIN "
        "(SELECT l_orderkey AS orderkey, l_linenumber, l_partkey FROM lineitem) l USING (orderkey)",
    ),
    # Bands are literals and do not overlap: each row meets one of three.
    "q_theta_join": (
        ["lineitem"],
        "SELECT band, COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem JOIN "
        "(SELECT * FROM VALUES ('small', 0, 10), ('middle', 10, 30), ('large', 30, 1000) AS b(band, low, high)) bands "
        "ON l_quantity >= low AND l_quantity < high GROUP BY band",
        "SELECT band, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN "
        "(SELECT * FROM (VALUES ('small', 0, 10), ('middle', 10, 30), ('large', 30, 1000)) AS b(band, low, high)) bands "
        "ON l_quantity >= low AND l_quantity < high GROUP BY band",
    ),
    "q_group_by": (
        ["lineitem"],
        "SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, "
        "COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 100",
    ),
    "q_grouping_sets": (
        ["orders"],
        "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS no_status, "
        "CAST(GROUPING(o_orderpriority) AS INT) AS no_priority, COUNT(*) AS n FROM orders "
        "GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    ),
    "q_rollup": (
        ["orders"],
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "q_cube": (
        ["orders"],
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    ),
    "q_agg": (
        ["lineitem"],
        "SELECT l_returnflag, COUNT(*) AS n, COUNT(l_tax) AS n_tax, "
        "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(CAST(MIN(l_shipdate) AS DATE) AS VARCHAR(10)) AS first_ship, "
        "MAX(l_extendedprice) AS highest, ROUND(AVG(l_quantity), 4) AS average, "
        "ROUND(STDDEV_POP(l_quantity), 4) AS deviation, COUNT(DISTINCT l_orderkey) AS n_orders "
        "FROM lineitem GROUP BY l_returnflag",
    ),
    "q_agg_window": (
        ["orders"],
        f"SELECT priority, ym, n, CAST(SUM(n) OVER w AS BIGINT) AS running, "
        f"CAST(SUM(n) OVER (PARTITION BY priority) AS BIGINT) AS overall, "
        f"CAST(MAX(total) OVER w AS DOUBLE) AS highest FROM ({MONTHLY}) m "
        f"WINDOW w AS (PARTITION BY priority ORDER BY ym)",
    ),
    "q_window_rows": (
        ["orders"],
        f"SELECT priority, ym, "
        f"CAST(SUM(n) OVER (PARTITION BY priority ORDER BY ym ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three, "
        f"CAST(SUM(n) OVER (PARTITION BY priority ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS BIGINT) "
        f"AS up_to_next, "
        f"CAST(SUM(n) OVER (PARTITION BY priority ORDER BY ym RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS BIGINT) "
        f"AS one_year FROM ({MONTHLY}) m",
    ),
    "q_window_rank": (
        ["orders"],
        f"SELECT priority, ym, CAST(ROW_NUMBER() OVER w AS INT) AS rn, CAST(RANK() OVER w AS INT) AS rk, "
        f"CAST(DENSE_RANK() OVER w AS INT) AS dr, LAG(n, 1) OVER o AS before, LEAD(n, 1) OVER o AS after, "
        f"FIRST_VALUE(ym) OVER o AS first_ym, "
        f"LAST_VALUE(ym) OVER (PARTITION BY priority ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND "
        f"UNBOUNDED FOLLOWING) AS last_ym, CAST(NTILE(4) OVER o AS INT) AS quarter FROM ({MONTHLY}) m "
        f"WINDOW w AS (PARTITION BY priority ORDER BY n DESC, ym), o AS (PARTITION BY priority ORDER BY ym)",
    ),
    "q_order_by": (
        ["customer"],
        "SELECT c_custkey, c_mktsegment, NULLIF(c_nationkey, 3) AS nation FROM customer "
        "ORDER BY nation ASC NULLS LAST, c_mktsegment DESC NULLS FIRST, c_custkey",
    ),
    "q_limit_offset": (
        ["orders"],
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    ),
    "q_top_k": (
        ["orders"],
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    ),
    "q_distribute_sort": (
        ["orders"],
        "SELECT o_orderkey, o_custkey FROM orders DISTRIBUTE BY o_orderkey SORT BY o_custkey, o_orderkey",
        "SELECT o_orderkey, o_custkey FROM orders",
    ),
    "q_cluster_by": (
        ["orders"],
        "SELECT o_orderkey, o_totalprice FROM orders CLUSTER BY o_orderkey",
        "SELECT o_orderkey, o_totalprice FROM orders",
    ),
    "q_union": (
        ["customer", "supplier"],
        "SELECT nation, kind FROM (SELECT c_nationkey AS nation, 'c' AS kind FROM customer UNION "
        "SELECT s_nationkey AS nation, 's' AS kind FROM supplier) u UNION ALL "
        "SELECT s_nationkey AS nation, 'all' AS kind FROM supplier",
    ),
    "q_intersect": (
        ["orders", "customer"],
        "SELECT key, 'set' AS kind FROM (SELECT c_custkey AS key FROM customer INTERSECT "
        "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P') a UNION ALL "
        "SELECT key, 'all' AS kind FROM (SELECT l AS key FROM (SELECT o_custkey AS l FROM orders WHERE o_orderstatus = 'O') x "
        "INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') b",
        "SELECT key, 'set' AS kind FROM (SELECT c_custkey AS key FROM customer INTERSECT "
        "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'P') a UNION ALL "
        "SELECT key, 'all' AS kind FROM (SELECT l AS key FROM (SELECT o_custkey AS l FROM orders WHERE o_orderstatus = 'O') x "
        "INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') b",
    ),
    "q_except": (
        ["orders", "customer"],
        "SELECT key, 'set' AS kind FROM (SELECT c_custkey AS key FROM customer EXCEPT "
        "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P') a UNION ALL "
        "SELECT key, 'all' AS kind FROM (SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' "
        "EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') b",
        "SELECT key, 'set' AS kind FROM (SELECT c_custkey AS key FROM customer EXCEPT "
        "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'P') a UNION ALL "
        "SELECT key, 'all' AS kind FROM (SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' "
        "EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') b",
    ),
    "q_with": (
        ["orders", "customer"],
        "WITH spent AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey), "
        "big AS (SELECT * FROM spent WHERE total > 1500000) "
        "SELECT c.c_mktsegment, COUNT(*) AS n, CAST(SUM(b.total) AS DOUBLE) AS total "
        "FROM big b JOIN customer c ON b.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    ),
    # The inner average is joined by hand: grouping by a hash as well lets the join
    # split a part with very many lines, see viewforge.operators.joins.group_for_join.
    "q_subquery": (
        ["lineitem", "orders"],
        "SELECT d.l_orderkey, d.l_linenumber, d.l_quantity FROM "
        "(SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem WHERE l_returnflag = 'R') d JOIN "
        "(SELECT l_partkey, AVG(l_quantity) AS average FROM lineitem GROUP BY l_partkey, XXHASH64(l_partkey)) i "
        "ON i.l_partkey = d.l_partkey WHERE d.l_quantity > i.average "
        "AND d.l_orderkey < (SELECT MAX(o_orderkey) FROM orders WHERE o_orderstatus = 'P')",
        "SELECT d.l_orderkey, d.l_linenumber, d.l_quantity FROM "
        "(SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem WHERE l_returnflag = 'R') d "
        "WHERE d.l_quantity > (SELECT AVG(i.l_quantity) FROM lineitem i WHERE i.l_partkey = d.l_partkey) "
        "AND d.l_orderkey < (SELECT MAX(o_orderkey) FROM orders WHERE o_orderstatus = 'P')",
    ),
    "q_values": (
        ["orders"],
        "SELECT label, COUNT(*) AS n FROM orders JOIN VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial') "
        "AS s(code, label) ON o_orderstatus = code GROUP BY label",
        "SELECT label, COUNT(*) AS n FROM orders JOIN (VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial')) "
        "AS s(code, label) ON o_orderstatus = code GROUP BY label",
    ),
    "q_unnest": (
        ["embeddings"],
        "SELECT dimension, COUNT(*) AS n, CAST(MIN(item) AS DOUBLE) AS lowest, CAST(MAX(item) AS DOUBLE) AS highest "
        "FROM embeddings LATERAL VIEW POSEXPLODE(embedding) e AS dimension, item GROUP BY dimension",
        "SELECT CAST(dimension - 1 AS INT) AS dimension, COUNT(*) AS n, CAST(MIN(item) AS DOUBLE) AS lowest, "
        "CAST(MAX(item) AS DOUBLE) AS highest FROM (SELECT UNNEST(embedding) AS item, "
        "generate_subscripts(embedding, 1) AS dimension FROM embeddings) e GROUP BY dimension",
    ),
}


def _outer_join(condition):
    """All customers with those of their orders that fulfil the condition; one customer may have most of them."""

    def query(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").where(condition).select("o_custkey", "o_orderkey")
        customers = table(spark, sf_dir, "customer").select("c_custkey")
        return optional_join(customers, orders, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")

    return query


def right_join(spark, sf_dir):
    with_views(spark, sf_dir, "orders", "customer")
    return spark.sql(
        "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o "
        "RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey"
    )


def not_in_query(spark, sf_dir):
    """NOT IN a list and NOT IN a subquery whose column may be null."""
    customers = table(spark, sf_dir, "customer").where(~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"))
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey")
    return not_in(customers, "c_custkey", large).select("c_custkey", "c_name")


def not_in_with_null(spark, sf_dir):
    """One null among the values: no row at all passes; counted so that the result is not empty."""
    orders = table(spark, sf_dir, "orders")
    values = orders.select(F.nullif("o_custkey", F.lit(7)).alias("o_custkey"))
    left = not_in(table(spark, sf_dir, "customer"), "c_custkey", values)
    return left.agg(F.count(F.lit(1)).alias("n_left"))


def tablesample(spark, sf_dir):
    with_views(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)")


def insert(spark, sf_dir):
    """INSERT INTO and INSERT OVERWRITE of one partition of a table."""
    with_views(spark, sf_dir, "orders")
    path = scratch_path(spark, "q_insert")
    name = "q_insert_" + path.rsplit("-", 1)[1]
    spark.sql(
        f"CREATE TABLE {name} (o_orderkey BIGINT, o_totalprice DOUBLE, status STRING) USING PARQUET "
        f"PARTITIONED BY (status) LOCATION '{path}'"
    )
    try:
        for status in "OFP":
            spark.sql(
                f"INSERT INTO {name} PARTITION (status = '{status}') "
                f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = '{status}'"
            )
        spark.sql(
            f"INSERT OVERWRITE TABLE {name} PARTITION (status = 'P') "
            "SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus = 'P'"
        )
    finally:
        spark.sql(f"DROP TABLE {name}")
    schema = "o_orderkey BIGINT, o_totalprice DOUBLE, status STRING"
    return spark.read.schema(schema).parquet(path)


QUERIES = {name: run_sql(entry[1], *entry[0]) for name, entry in CLAUSES.items()}
QUERIES["q_left_join"] = _outer_join("o_orderstatus = 'P'")
QUERIES["q_right_join"] = right_join
QUERIES["q_right_join_hot"] = _outer_join("o_totalprice > 400000")
QUERIES["q_not_in"] = not_in_query
QUERIES["q_not_in_null"] = not_in_with_null
QUERIES["q_tablesample"] = tablesample
QUERIES["q_insert"] = insert

ORACLE = {name: entry[2] if len(entry) > 2 else entry[1] for name, entry in CLAUSES.items()}
ORACLE["q_left_join"] = (
    "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o "
    "ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'"
)
ORACLE["q_right_join_hot"] = ORACLE["q_right_join"] = (
    "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT OUTER JOIN customer c "
    "ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"
)
ORACLE["q_not_in"] = (
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') "
    "AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"
)
ORACLE["q_not_in_null"] = (
    "SELECT COUNT(*) AS n_left FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 7) FROM orders)"
)
ORACLE["q_insert"] = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, "
    "o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')"
)
