"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialise


def connected_components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links ``a``, ``b``; the root is the component's smallest node.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so the number of rounds grows with the logarithm of a
    component's diameter. Every round is written to the shared folder. Links
    of a node meet only as partial minima, so a node may have any number of them.
    Self-links and repeated links do no harm; null ends are dropped.
    """
    found = links.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    edges = materialise(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(rounds):
        best = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        near = labels.join(best, labels["node"] == best["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = near.join(up, "root").select("node", F.least("root", "above").alias("root"), (F.least("root", "above") < F.col("old")).alias("moved"))
        step = materialise(step, "labels")
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
