"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspan.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) can reach.

    Rounds of taking the smallest label among neighbours and then the label's own label,
    each written to the shared folder, until nothing changes. Minima are combined before
    each shuffle; joins on a node with very many links can be split, as one side has one
    row a node. Null ends and links of a node to itself add nothing; repeated links count
    once. Without links: no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        top = labels.select(F.col("node").alias("label"), F.col("component").alias("top"))
        new = cut(new.join(top, "label").select("node", F.least("label", "top").alias("component"), "old"))
        changed = not new.where("component <> old").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
