"""Connected components of a large graph by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); the component is the smallest id that can be reached.

    Every pass takes the least label among neighbours and then the label of that label, so a chain of n
    links needs about log2(n) passes. It ends when no label changes. Links to oneself are allowed, an empty table gives an empty result.
    """
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("least"))
        of = labels.select(F.col("id").alias("least"), F.col("component").alias("jump"))
        stepped = checkpoint(lower.join(of, "least").select("id", F.least("least", "jump").alias("new"), "component"))
        if not stepped.where(F.col("new") < F.col("component")).limit(1).count():
            return labels
        labels = stepped.select("id", F.col("new").alias("component"))
