"""Connected components of undirected edges, for many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import unlink, written


def components(nodes: DataFrame, edges: DataFrame, by: list[str], rounds: int = 50) -> DataFrame:
    """(by, node, label): the smallest node that each node reaches. ``edges``: by, a, b in either direction.

    Each round takes the smallest label next door, then the label's own label, so paths shrink by half.
    """
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "pairs")
    labels = step = written(nodes.select(*by, "node").distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(*by, F.col("node").alias("b"), "label"), [*by, "b"]).groupBy(*by, "a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), [*by, "node"], "left").select(*by, "node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        new = written(new, "labels")  # read twice
        jump = new.select(*by, F.col("node").alias("new"), F.col("new").alias("far"))
        before, step = step, written(new.join(jump, [*by, "new"], "left").select(*by, "node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        unlink(before, new)
        labels = step.select(*by, "node", F.col("new").alias("label"))
        if step.filter(F.col("new") < F.col("label")).isEmpty():
            unlink(both)
            return labels
    raise RuntimeError("components did not converge")
