"""Connected components by rounds of neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import shared_table
from viewforge.operators.joins import SPREAD, group_for_join


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``), a stored table; the root is the smallest node of its component.

    Each round takes the smallest root among the neighbours and then that root's own
    root, so chains shrink by halves. Rounds are written to the shared folder. Hot nodes
    are reduced on the map side and split in the joins. ``rows`` is a bound of the nodes, for the number of files.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    labels = shared_table(first, "roots", rows)
    while True:
        offers = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "root", F.lit(None).alias("old"))
        own = labels.select("node", "root", F.col("root").alias("old"))
        smallest = offers.unionByName(own).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        jumps = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = smallest.join(jumps, "root").select("node", F.least("root", "next").alias("root"), "old")
        new = shared_table(moved, "roots", rows)
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels


def sizes(roots: DataFrame) -> DataFrame:
    """``root, size``, laid out so that a join on the root can split hot components."""
    return group_for_join(roots, ["root"]).agg(F.count(F.lit(1)).alias("size")).drop(SPREAD)
