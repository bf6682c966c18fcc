"""Lineage graphs held as edge tables.

Table edges are ``node, dep``: ``node`` is computed from ``dep``. Field edges
have the same shape with field ids. Closures walk outwards from a start set, to
both sides in the same rounds; a round follows only the nodes found last, and nodes
already seen are dropped, so cycles end.

Long ways are shortened by path doubling: where walks of 2**k steps from a node end at
two nodes at most, links to these are kept, and the next round joins them to walks of
twice the length. That starts when two rounds in a row found no more than the one
before, as wide graphs are rarely deep. Chains, ladders and cycles of any length are so covered in a
logarithmic number of rounds; elsewhere a round is one step. Links only lead to nodes
that can be reached anyway, so the result is that of single steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from viewforge.operators.joins import group_for_join
from viewforge.session import scratch_path

#: The column an edge starts at and the one it leads to, seen from the start.
WAYS = {"backward": ("node", "dep"), "forward": ("dep", "node")}


def _kept(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The rows, written, and their number."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def _follow(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where links from the nodes lead; few nodes are sent to the links, which then are not shuffled."""
    here = nodes.select("way", F.col("id").alias("source"))
    return links.join(here, ["way", "source"], "left_semi").select("way", F.col("target").alias("id"))


def _doubled(links: DataFrame) -> DataFrame:
    """Links of twice the length, from sources with two targets at most through middles with two at most."""
    ends = links.groupBy("way", "source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("a"), F.max("target").alias("b"))
    few = ends.where("n <= 2").select("way", "source", F.explode(F.array_distinct(F.array("a", "b"))).alias("target"))
    middle = few.select("way", F.col("target").alias("source"), F.col("source").alias("start"))
    return middle.join(few, ["way", "source"]).select("way", F.col("start").alias("source"), "target").distinct()


def closure(edges: DataFrame, start: DataFrame, ways: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``way, source, target`` of all edges, and ``way, id`` of everything reached from the start ids, these included."""
    spark, base = edges.sparkSession, scratch_path(edges.sparkSession, "closure")
    pairs = edges.select("node", "dep").distinct()
    steps = [pairs.select(F.lit(w).alias("way"), F.col(WAYS[w][0]).alias("source"), F.col(WAYS[w][1]).alias("target")) for w in ways]
    laid = reduce(DataFrame.unionByName, steps).hint("rebalance", F.col("way"), F.col("source")).sortWithinPartitions("way", "source")
    links, _ = _kept(laid, f"{base}/steps")
    levels, ids = [links], start.select("id").distinct()
    found = reduce(DataFrame.unionByName, (ids.select(F.lit(w).alias("way"), "id") for w in ways))
    paths: list[str] = []
    sizes: list[int] = []
    doubling = False
    while True:
        path = f"{base}/found-{len(paths)}"
        last, n = _kept(found, path)
        paths.append(path)
        seen = spark.read.schema(last.schema).parquet(*paths)
        if not n:
            return links, seen
        reached = [_follow(level, last) for level in levels]
        sizes.append(n)
        narrow = len(sizes) > 2 and sizes[-3] >= sizes[-2] >= n
        if doubling or len(levels) == 1 and narrow:
            longer, doubling = _kept(_doubled(levels[-1]), f"{base}/links-{len(levels)}")
            levels.append(longer)
            if doubling:
                reached.append(_follow(longer, seen))
        found = reduce(DataFrame.unionByName, reached).distinct().join(seen, ["way", "id"], "left_anti")


def _touching(links: DataFrame, seen: DataFrame) -> DataFrame:
    return links.join(seen.select("way", F.col("id").alias("source")), ["way", "source"], "left_semi")


def upstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start, ["backward"])[1].select("id")


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start, ["forward"])[1].select("id")


def table_lineage(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Edges on the way to and from the start tables, as ``from_table, to_table``."""
    found = _touching(*closure(edges, start, list(WAYS)))
    back = F.col("way") == "backward"
    return found.select(
        F.when(back, F.col("target")).otherwise(F.col("source")).alias("from_table"),
        F.when(back, F.col("source")).otherwise(F.col("target")).alias("to_table"),
    ).distinct()


def field_lineage(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``direction, from_field, to_field``; in both directions edges lead away from the start."""
    found = _touching(*closure(edges, start, list(WAYS)))
    return found.select(F.col("way").alias("direction"), F.col("source").alias("from_field"), F.col("target").alias("to_field"))


def transitive_dependencies(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything the start depends on, without the start."""
    return upstream(edges, start).join(start.select("id"), "id", "left_anti")


def transitive_successors(edges: DataFrame, start: DataFrame) -> DataFrame:
    return downstream(edges, start).join(start.select("id"), "id", "left_anti")


def declared_lineage(field_edges: DataFrame, fields: DataFrame) -> DataFrame:
    """Explicit field edges of the declared fields: ``view, field, dep_view, dep_field``."""
    return field_edges.join(fields.select("view", "field"), ["view", "field"], "left_semi").select(
        "view", "field", "dep_view", "dep_field"
    )


def blackbox_lineage(fields: DataFrame, table_edges: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Every field of a view from every field of the views it depends on.

    Views with explicit edges use only those. A view without dependencies has
    each field depend on itself. The result is the product of two field lists per
    edge by definition; a list is as long as a table is wide.
    """
    named = fields.select("view", "field")
    edges = table_edges.select("view", "dep_view")
    if explicit is None:
        open_edges, settled = edges, edges.select("view")
    else:
        declared = explicit.select("view").distinct()
        open_edges = edges.join(declared, "view", "left_anti")
        settled = edges.select("view").unionByName(explicit.select("view"))
    # Edges first meet the fields they come from: an edge to a view without fields
    # ends there, instead of being repeated for every field of its own view.
    of_deps = named.select(F.col("view").alias("dep_view"), F.col("field").alias("dep_field"))
    sources = open_edges.distinct().join(of_deps, "dep_view")
    derived = named.join(sources, "view").select("view", "field", "dep_view", "dep_field")
    with_lineage = group_for_join(settled, ["view"]).agg(F.lit(True).alias("_settled")).select("view")
    own = named.join(with_lineage, "view", "left_anti").select(
        "view", "field", F.col("view").alias("dep_view"), F.col("field").alias("dep_field")
    )
    result = derived.unionByName(own)
    if explicit is not None:
        result = result.unionByName(declared_lineage(explicit, named))
    return result


def _grouped(edges: DataFrame, own: str, other: str) -> DataFrame:
    """``field, other_table, other_fields`` from edges of ``table.field`` structs."""
    return (
        edges.select(
            F.col(f"{own}_field").alias("field"),
            F.col(f"{other}_table").alias("other_table"),
            F.col(f"{other}_field").alias("other_field"),
        )
        .distinct()
        .groupBy("field", "other_table")
        .agg(F.array_sort(F.collect_list("other_field")).alias("other_fields"))
    )


def field_dependencies_grouped(edges: DataFrame, table: str) -> DataFrame:
    """Per field of the table and table it comes from: the fields it comes from.

    Edges are ``node_table, node_field, dep_table, dep_field``. Fields without
    edges are left out.
    """
    return _grouped(edges.where(F.col("node_table") == table), "node", "dep")


def field_successors_grouped(edges: DataFrame, table: str) -> DataFrame:
    return _grouped(edges.where(F.col("dep_table") == table), "dep", "node")


def catalog_edges(views: DataFrame) -> DataFrame:
    """Nested view descriptions flattened to ``kind, from_id, to_id`` rows.

    Each row holds ``name``, ``dependencies`` (table name to partition list) and
    ``lineage`` (own field to list of other fields). A field edge to itself is
    dropped.
    """
    by_table = views.select("name", F.explode("dependencies").alias("dep_table", "dep_partitions"))
    tables = by_table.select(
        F.lit("table").alias("kind"), F.col("name").alias("from_id"), F.col("dep_table").alias("to_id")
    )
    partitions = by_table.select(
        F.lit("partition").alias("kind"), F.col("name").alias("from_id"), F.explode("dep_partitions").alias("to_id")
    )
    fields = (
        views.select("name", F.explode("lineage").alias("own", "others"))
        .select(
            F.lit("field").alias("kind"),
            F.concat_ws(".", "name", "own").alias("from_id"),
            F.explode("others").alias("to_id"),
        )
        .where(F.col("from_id") != F.col("to_id"))
    )
    return tables.unionByName(partitions).unionByName(fields).distinct()
