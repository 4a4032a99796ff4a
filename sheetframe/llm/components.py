"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), a written table, to (node, label): the least node of its component. Each round takes the least
    label among the neighbours (combined before the shuffle) and then the label's label. Both joins read written tables on
    both sides, so that adaptive execution can split the partition of a node with very many neighbours. Labels only fall, so
    an unchanged sum means the end; nothing but that sum comes to the driver."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"))
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    total = _total(labels)
    while True:
        near = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        lower = saved(near.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        up = lower.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        jumped = saved(lower.join(up, F.col("label") == F.col("up_node")).select("node", F.col("up_label").alias("label")))
        release(lower, labels)
        labels, before, total = jumped, total, _total(jumped)
        if total == before:
            release(both)
            return labels
