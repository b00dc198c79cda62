"""Connected components of a node-to-group table, by min labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pin


def components(members: DataFrame) -> DataFrame:
    """(node, label) from (node, grp): nodes that share a group, directly or over others, get their smallest node as label.

    A round takes each group's smallest label (aggregated before the shuffle), each node's smallest over its groups, and
    then the label's own label, so that a chain of n groups takes about log n rounds. Group minima are written before
    they are joined, so the join sees plain tables and splits a group that holds much of the rows.
    """
    current = pin(members.select("node", "grp", F.col("node").alias("label")))
    while True:
        lowest = pin(current.groupBy("grp").agg(F.min("label").alias("low")))
        nearest = pin(
            current.join(lowest, "grp").groupBy("node")
            .agg(F.min(F.least("label", "low")).alias("label"), F.max(F.col("low") < F.col("label")).alias("moved"))
        )
        if nearest.where("moved").isEmpty():
            return nearest.select("node", "label")
        beyond = nearest.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = pin(nearest.drop("moved").join(beyond, "label", "left").select(
            "node", F.coalesce("next", "label").alias("label")))
        current = pin(current.drop("label").join(jumped, "node"))
