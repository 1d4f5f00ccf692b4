"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a, b): the smallest id it is linked with.

    Each round gives a node the smallest label of a label among its own and its
    neighbours', and gives the same to the node that its label names, so that whole
    groups move at once: the rounds grow with the logarithm of a chain's length. They
    end when nothing moves; labels only fall, so they do end. All steps reduce before they
    shuffle; labels are written to the shared folder, so a lost executor costs one round.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        root = labels.select(F.col("id").alias("root"), F.col("component").alias("top"))
        tops = labels.join(root, labels["component"] == root["root"]).select("id", "component", "top")
        near = edges.join(tops, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("top").alias("near"))
        seen = written(tops.join(near, "id").select("id", "component", F.least("top", "near").alias("low")))
        hooks = seen.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("hook"))
        fresh = written(seen.join(hooks, seen["id"] == hooks["root"], "left").select("id", F.least("low", "hook").alias("component"), F.col("component").alias("old")))
        moved = fresh.where("component <> old").limit(1).count()
        discard(labels, seen)
        labels = fresh.select("id", "component")
        if not moved:
            discard(edges)
            return labels
