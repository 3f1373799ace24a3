"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settle


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that links reach, for every node in columns a and b.

    Each round the least label among a node's neighbours goes to the node and to the node
    that labels it; then every node takes the label of its label. Trees of labels hook onto
    each other by their roots, so rounds grow with the logarithm of the number of nodes on
    a path. Labels stay in the shared folder; only whether any changed reaches the driver.
    """
    pairs = settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = settle(pairs.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        near = pairs.join(labels.select(F.col("node").alias("v"), F.col("label").alias("other")), "v")
        near = near.groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        told = labels.join(near, "node").select("other", F.explode(F.array("node", "label")).alias("node"))
        told = told.groupBy("node").agg(F.min("other").alias("other"))
        hooked = labels.join(told, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        hooked = settle(hooked)
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = settle(hooked.join(above, "label", "left").select("node", F.least("label", "top").alias("label"), "old"))
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
