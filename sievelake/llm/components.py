"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then
    that label's own label, so long chains shrink by halves. Rounds go on until
    nothing changes. Labels are written to the shared folder after every round;
    rows of one hub are reduced before they are shuffled, and joins on a hub's
    key can be split by Spark.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low")).select("node", F.least("node", "_low").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_mid"))
        jump = labels.select(F.col("node").alias("_mid"), F.col("label").alias("_far"))
        after = cut_lineage(lower.join(jump, "_mid", "left").select("node", F.least("_mid", "_far").alias("label"), "_old"))
        labels = after.select("node", "label")
        if after.filter(F.col("label") != F.col("_old")).isEmpty():
            return labels
