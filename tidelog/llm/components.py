"""Connected components of a graph held as edges, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node to the least among them and the node.

    With ``larger`` the larger neighbours are linked, else the smaller and the node.
    """
    if larger:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    linked = both.join(least, "a")
    if larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        own = least.where("a <> low").select("a", F.col("low").alias("b"))
        out = linked.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(own)
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the label is its component's least node.

    Large and small stars in turns; each round's edges are a stored table, and
    the rounds end when they no longer change. Self-links are ignored.
    """
    now = stored(edges.where("a <> b").select("a", "b").distinct(), "component-edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = stored(_star(_star(now, True), False), "component-edges")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
