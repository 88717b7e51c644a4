"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (hi, lo) with hi > lo."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("m"))
    large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
    return small.select("e.*").filter("hi <> lo").distinct()


def component_of(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of nodes (node, `name`) and edges (a, b): label is the smallest `name` of the component.

    Stars need about log(n) rounds, whatever the diameter.  Isolated nodes keep their own name; an empty edge
    table costs one round; nulls in `name` are ignored by the minimum.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, now = mark, cut(_stars(now))
    rooted = cut(nodes.join(now, nodes["node"] == now["hi"], "left").select("node", name, F.coalesce("lo", "node").alias("root")))
    return rooted.join(rooted.groupBy("root").agg(F.min(name).alias("label")), "root").select("node", "label")
