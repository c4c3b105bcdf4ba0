"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of links (a long, b long).

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so
    a path of n nodes needs about log n rounds. Labels stay in tables; only the number of changes reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = stored(own.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), (F.least("to", F.coalesce("further", "to")) < F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = step
        if not step.filter("moved").limit(1).count():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
