"""Connected components of an edge table, as rounds of joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.sources.stores import materialise


def components(edges: DataFrame, name: str = "components", rounds: int | None = None) -> DataFrame:
    """``node, component``: the smallest node that edges ``a, b`` reach, for every node that has an edge.

    Every round takes the smallest label among a node and its neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of a component's width on usual graphs. Each round is stored in the shared folder. Minima
    are aggregated before the shuffle; a node with very many edges is split by the skew join. With ``rounds`` it may stop early:
    then equal labels still mean one component, but a component may have several labels.
    """
    left = rounds
    both = materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), name
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), name)
    while left is None or left > 0:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = nearer.join(roots, "component", "left").select("node", F.least("component", "root").alias("component"), "old")
        stored = materialise(jumped, name)
        labels = stored.select("node", "component")
        if left is not None:
            left -= 1
        elif stored.where("component <> old").isEmpty():
            break
    return labels
