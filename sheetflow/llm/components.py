"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, where: str, most_rounds: int = 60) -> DataFrame:
    """A row (node, label) for each node of the links (a, b); label is the smallest node reachable.

    Each round takes the least label of all neighbours (a map-side minimum, so hubs are no hot
    keys), then jumps to the label of the label. Rounds grow with the logarithm of a chain's
    length; each is stored, so nothing is recomputed when an executor is lost.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    both = stored(both, f"{where}/links")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("label")), f"{where}/labels-0")
    for k in range(1, most_rounds):
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        hop = stored(hop, f"{where}/hop-{k}")
        jump = hop.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(hop.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), f"{where}/labels-{k}")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
