"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the smallest node that links reach.

    Each round a node takes the least label among its neighbours' and its own, then its label's
    label, which halves what is left of long chains; each round's table is stored. Links stay
    distributed; their number is at most that of the candidate pairs.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(edges, "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        above = new.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = stored(new.join(above, new.label == above.up).select("node", "was", F.least("label", "up_label").alias("label")), "labels")
        changed = not new.where("was <> label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels
