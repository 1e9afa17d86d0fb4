"""Connected components of a link table: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Every round takes the smallest label among a node's neighbours and then its label's label, so
    the number of rounds grows with the logarithm of a component's width. Labels are written to
    the shared folder after each round. Self links keep a node in the result.
    """
    size = (links,) if hasattr(links, "stored_in") else ()
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = stored(labels, "labels", size)
    while True:
        near = (both.join(labels.select("node", "component"), F.col("b") == F.col("node")).groupBy("a")
                .agg(F.min("component").alias("near")))
        new = (labels.select("node", "component").join(near, F.col("node") == F.col("a"), "left")
               .select("node", F.col("component").alias("was"),
                       F.least("component", "near").alias("component")))
        top = labels.select(F.col("node").alias("top"), F.col("component").alias("above"))
        new = stored(new.join(top, F.col("component") == F.col("top"), "left")
                     .select("node", "was", F.least("component", "above").alias("component")), "labels", size)
        discard(labels)
        if new.where("component < was").isEmpty():
            return new
        labels = new
