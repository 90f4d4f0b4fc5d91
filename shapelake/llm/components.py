"""Connected components of a graph of links, by labels that shrink to the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component, from (u, v) of longs; loops and repeats do no harm.

    Each round takes the least label among neighbours, then the label of the label. Links and labels stay in tables;
    the driver only sees whether a round changed anything. Hubs are summed before the shuffle and split by the join.
    """
    both = stored(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old")), "lower").withColumnRenamed("low", "label")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
