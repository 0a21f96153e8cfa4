"""Connected components of a graph whose edges are a table: every node gets the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialweave.session import cut_lineage, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: comparable, not null); root is the component's smallest node.

    Alternating large-star and small-star steps: each node's larger (then smaller) neighbours are linked to its smallest
    neighbour, which halves long paths. A step is two aggregations and joins over the edges, so no task holds a component; hot
    nodes are aggregated before the shuffle and their join is an ordinary one that AQE can split. Each round is
    written, so a lost executor rereads it, and the one before is deleted. Self links only add the node itself. No edges: no rows.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    signature = None
    while True:
        before = links
        both = links.union(links.select(F.col("v"), F.col("u"))).where("u <> v")
        links = _star(both, F.col("v") > F.col("u"))
        links = cut_lineage(_star(links.where("u <> v"), F.lit(True)))
        discard(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(roots.where("node <> root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _star(links: DataFrame, moved) -> DataFrame:
    """Link the chosen neighbours v of each u, and u itself, to the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
    joined = links.join(least, F.col("u") == F.col("_u"))
    out = joined.where(moved).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
