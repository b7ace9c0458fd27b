"""Weighted graphs as edge tables (src, dst, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.operators.lineage import written


def node_weights(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src", "dst")).alias("node")
    return edges.select(ends, "w").groupBy("node").agg(F.sum("w").alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, its ends in order, weights added up."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, t): how many triangles each node is a corner of; edges (src, dst) are distinct, undirected and no loops.

    Edges are turned to point at the end of the higher degree (ties to the greater name), so no node has more than the
    square root of twice the edges going out, and wedges are as many as edges times that at most.
    """
    deg = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    e = edges.join(deg.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    end = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    out = e.select(end("src", "dst").alias("u"), end("dst", "src").alias("v"), end("dd", "ds").alias("d"))
    other = out.select("u", F.col("v").alias("w"), F.col("d").alias("dw"))
    wedge = out.join(other, "u").where(F.struct("d", "v") < F.struct("dw", "w")).select("u", "v", "w")
    found = wedge.join(out.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_semi")
    return found.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree, average clustering; null where there is nothing to divide.  A self-loop adds 2 to a degree and isn't part of a triangle."""
    e = written(undirected(edges).select("src", "dst"), "edges")
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    simple = e.where("src <> dst")
    near = simple.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    local = deg.join(near, "node", "left").join(triangles(simple), "node", "left")
    c = F.coalesce(F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))), F.lit(0.0))
    nodes = local.agg(F.count("*").alias("nodes"), F.avg("d").alias("degree"), F.avg(c).alias("clustering"))
    return nodes.crossJoin(e.agg(F.count("*").alias("edges"))).select("nodes", "edges", F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), "degree", "clustering")  # one row each


def jaccard(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the Jaccard index of the distinct rows; null if both are empty."""
    both = a.select(*columns).distinct().withColumn("_a", F.lit(1)).join(b.select(*columns).distinct().withColumn("_b", F.lit(1)), columns, "full")
    return both.agg(F.try_divide(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)), F.count("*")).alias("jaccard"))


def regions(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: how many values are in the first only, in both, in the second only."""
    both = a.select(column).distinct().withColumn("_a", F.lit(1)).join(b.select(column).distinct().withColumn("_b", F.lit(1)), column, "full")
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(n(F.col("_b").isNull()).alias("only_first"), n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), n(F.col("_a").isNull()).alias("only_second"))


def unique_edges(edges: DataFrame, others: DataFrame) -> DataFrame:
    """Edges that the others don't have, with their own weights."""
    return edges.join(others.select("src", "dst"), ["src", "dst"], "left_anti")
