"""Graphs as tables of edges: relations of an entity, shortest paths, PageRank. Iterations cut their lineage to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagitta.sources.files import cut, done


def relations(edges: DataFrame, entity) -> DataFrame:
    """The edges (src, dst) that touch an entity."""
    return edges.where((F.col("src") == entity) | (F.col("dst") == entity))


def shortest_path(edges: DataFrame, start, goal, most: int = 5) -> list | None:
    """The nodes of a shortest path between two nodes, edges taken both ways; None if there is none of most edges.

    Breadth first: each turn joins the frontier to the edges and keeps new nodes only, with the least of their parents.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    kind = dict(edges.dtypes)["src"]
    if start == goal:
        return [start]
    seen = edges.sparkSession.createDataFrame([(start, None, 0)], f"node {kind}, parent {kind}, depth int")
    for depth in range(1, most + 1):
        frontier = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        new = both.join(frontier, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        seen, old = cut(seen.unionByName(new), "seen"), seen
        done(old)
        if not seen.where(F.col("node") == goal).isEmpty():
            path = [goal]
            while path[-1] != start:
                path.append(seen.where(F.col("node") == path[-1]).first()["parent"])
            return path[::-1]
        if seen.where(F.col("depth") == depth).isEmpty():
            return None
    return None


def distances(edges: DataFrame, start, most: int = 5) -> DataFrame:
    """node and depth for all nodes within most edges of start, edges taken both ways."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    kind = dict(edges.dtypes)["src"]
    seen = edges.sparkSession.createDataFrame([(start, 0)], f"node {kind}, depth int")
    for depth in range(1, most + 1):
        frontier = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        new = both.join(frontier, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen, old = cut(seen.unionByName(new.withColumn("depth", F.lit(depth))), "seen"), seen
        done(old)
        if seen.where(F.col("depth") == depth).isEmpty():
            break
    return seen


def page_rank(edges: DataFrame, damping: float = 0.85, turns: int = 10) -> DataFrame:
    """node and rank. Every node begins with 1 / n; parallel edges count each; what ends in a node without edges is lost."""
    arcs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    arcs = arcs.withColumn("share", F.col("times") / F.sum("times").over(Window.partitionBy("src"))).select("src", "dst", "share")
    arcs = cut(arcs, "arcs")
    nodes = cut(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct(), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    for turn in range(turns):
        given = arcs.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(given, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if turn % 3 == 2:
            ranks = cut(ranks, "ranks")
    return ranks


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges that are left when edges from or to nodes without others behind or before them are taken away in turn.

    None are left exactly if the graph has no cycle. The turns end when one takes nothing away.
    """
    left = cut(edges.select("src", "dst").distinct(), "edges")
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left, old = cut(inner.select("src", "dst"), "edges"), left
        done(old)
        n, before = left.count(), n
        if n == before:
            break
    return left
