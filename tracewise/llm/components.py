"""Connected components by alternating large-star and small-star steps, each a pair of joins.

A node of many edges, such as the centre of a star, is no hot task: joins on nodes broadcast the few
nodes that hold more than a fixed share of all edges (shared.spread_join).

Defined results: an edge with a null end, or with equal ends, links nothing; repeated edges count
once; nodes without edges to others are not listed; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import drop_written, spread_join, written


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Links each node's neighbours to the smallest of them and the node: the larger neighbours, or the smaller ones and the node. Written. n: the number of edges."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")), "least", 2 * n)
    linked = spread_join(both, least, "a", "n")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("a <> m").select("a", F.col("m").alias("b")))
    out = written(out.distinct(), "edges", 2 * n)
    drop_written(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b) of whole numbers: (node, component), component the smallest node reachable.

    Steps go on until they change nothing; their number grows with the logarithm of the nodes.
    Each step is written to the shared folder, so a lost executor costs one step.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n = edges.count()
    edges = written(edges.distinct(), "edges", n)
    before = None
    while True:
        half = _stars(edges, True, n)
        drop_written(edges)
        edges = _stars(half, False, n)
        drop_written(half)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
