"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b): the label is the smallest node of the component.

    Each round every node takes the smallest label around it and then its label's
    own label, until nothing changes. Rounds are stored tables, so lost executors
    cost one round. Only a count comes to the driver.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        taken = materialise(labels.join(seen, labels["node"] == seen["a"])
                            .select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "taken")
        of = taken.select(F.col("node").alias("n2"), F.col("label").alias("up"))
        jumped = materialise(taken.join(of, taken["label"] == of["n2"]).select("node", "up", "old"), "jumped")
        changed = jumped.where(F.col("up") < F.col("old")).count()
        labels = jumped.select("node", F.col("up").alias("label"))
        if not changed:
            return labels
