"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links: the least node it is connected with.

    Each round hangs the larger neighbours of a node under its least neighbour, then all of its smaller ones; links
    become stars in a number of rounds that follows the logarithm of the nodes. Every step is an aggregate that combines
    on the map side and an equi-join; rounds are written, so a lost executor repeats one round at most.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = stage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    edges = stage(links.filter("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    marks = None
    while True:
        either = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(edges.select("low", "high"))
        centre = either.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        hung = either.filter("other > node").join(centre, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        lowest = hung.groupBy("high").agg(F.min("low").alias("least"))
        pairs = hung.join(lowest, "high").select(F.explode(F.array(F.struct("high", F.col("least").alias("low")), F.struct(F.col("low").alias("high"), F.col("least").alias("low")))).alias("e"))
        edges = stage(pairs.select("e.high", "e.low").filter("high != low").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == marks or not now[0]:
            break
        marks = now
    roots = edges.withColumnsRenamed({"high": "node", "low": "component"})
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
