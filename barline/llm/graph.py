"""Connected components over an edge table, by label minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of every node of the edge table ``a, b``.

    In each round every node takes the smallest label of its neighbours, then
    the label of its label, so a chain shrinks by a constant factor.  All steps
    are minimums summed inside the tasks and joins with one row per node on one
    side; each round is a written table, so that a lost executor costs a re-read.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = settle(labels.withColumn("label", F.least("node", "label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = settle(step, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = step.join(jump, "label", "left").select("node", "was", F.coalesce("far", "label").alias("label"))
        after = settle(after, "labels")
        if after.filter("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
