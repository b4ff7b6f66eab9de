"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so a chain shortens by half and a star is done at once. The minimum combines
    map-side, hence a node with very many links is no hot key. Labels are written to the
    shared folder each round. A link with a null end is ignored.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a IS NOT NULL AND b IS NOT NULL"), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage(
            moved.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels"
        )
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
