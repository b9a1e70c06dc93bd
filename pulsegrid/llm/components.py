"""Connected components of an undirected graph, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(key, component) of every end of edges(a, b); the component is its smallest key.

    Each round takes the least label among the neighbours and then the label of
    that label, so chains shorten by half a round. Every round is a written
    table; nothing but the number of changed labels reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "key"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "key").select("key", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("key").alias("component"), F.col("component").alias("root"))
        jumped = step.join(root, "component", "left").select("key", "old", F.least("component", "root").alias("component"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("key", "component")
        if not jumped.where(F.col("old") != F.col("component")).limit(1).count():
            return labels
