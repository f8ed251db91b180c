"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import kept_lineage_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours and then that label's own label, so paths halve.
    Minima are combined before the shuffle, so a node with very many neighbours is no burden.
    """
    both = kept_lineage_cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept_lineage_cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                              .select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        taken = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = taken.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = kept_lineage_cut(taken.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        changed = new.filter("label != old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
