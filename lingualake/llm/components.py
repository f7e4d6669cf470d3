"""Connected components of a table of links, without collecting any of it.

Nodes with many links and labels that many nodes share are hot keys of joins whose other side has one row
for a key; groups of them are reduced before the shuffle, and the adaptive skew join splits the rest.

Cases: repeated links count once, links in both directions too; a link of a node with itself, and nodes
without a link, give no row. Links with a null end must be left out before. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: the smaller neighbours of a node meet the smallest of them, not the node.

    A node that many of its buckets link to different leaders keeps one link, and the links between leaders
    repeat from node to node, so few distinct ones are left.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    low = staged(down.join(down.groupBy("a").agg(F.min("b").alias("low")), "a"))
    return low.select("a", F.col("low").alias("b")).union(low.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for each node of `links` (a, b): the smallest node it is connected to.

    Labels are lowered to the smallest among neighbours, then to their label's label, until none changes,
    so the rounds grow with the logarithm of a component's width.
    """
    links = staged(_contracted(links))
    both = staged(links.select("a", "b").union(links.select("b", "a")))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = staged(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
