"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the least node of its component, for every node that has a link.

    A node takes the least label around it (pre-aggregated, so a hub is no hot key of a sum), then its label's label.
    Each round is checkpointed; only the number of changes comes to the driver.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct()
    both = shared_checkpoint(both)
    labels = shared_checkpoint(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")))
    while True:
        around = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("least"))
        lower = labels.join(around, F.col("node") == F.col("x"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label"))
        to = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = shared_checkpoint(lower.join(to, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
