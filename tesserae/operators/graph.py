"""Connected components of an edge table, by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): label is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, hands it to the node its
    old label names, and jumps to the label of its label; the rounds grow with the logarithm of
    the longest path.  Minima are combined before each shuffle, so a hub costs one row a task.
    Only labels that change are joined back, and both sides of that join are plain tables: they
    are broadcast while small, and beyond that a component's many rows can be split among tasks.
    Null ends and self-loops are ignored.
    """
    e = edges.filter("a <> b").select("a", "b")
    e = saved(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = saved(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = e.join(lab.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = saved(lab.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "m").alias("low")))
        hook = saved(step.groupBy("label").agg(F.min("low").alias("hooked")).filter("hooked < label"))
        if hook.isEmpty():
            return lab
        low = step.join(hook, "label", "left").select("node", F.least("low", F.coalesce("hooked", "low")).alias("label"))
        low = saved(low)
        jump = low.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("further"))
        lab = saved(low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")))
