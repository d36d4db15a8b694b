"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node in ``links`` (``a``, ``b``): the smallest node that it is joined to.

    Every round takes the smallest label among the neighbours and then the label of that label, so that
    paths halve. A node's labels are reduced to their minimum before they are shuffled. Each round is
    stored in the shared folder, so lost executors cost a re-read; only a count reaches the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("root").alias("low"))
        )
        nearest = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "low").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = stored(
            nearest.join(jump, "next", "left").select("node", "old", F.least("next", "far").alias("root")), "labels"
        )
        labels = moved.select("node", "root")
        if moved.where(F.col("root") != F.col("old")).isEmpty():
            return labels
