"""Connected components by minimum labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import dropped, written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``); component is the smallest node.

    In each round a node takes the smallest label among its own, its neighbours' and that which its label
    has itself, so long chains shrink by halves. Minima are taken map-side; a node with very many links
    is only a skewed join side, which adaptive execution splits. Each round's labels are written to the
    shared folder, once. Nulls and self links are ignored; no links give no rows.
    """
    one = links.select("a", "b").where("a <> b")
    both = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        to = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = labels.join(near, "node").join(to, "component").select("node", F.col("component").alias("old"), F.least("component", "m", "further").alias("component"))
        new = written(new, "labels")
        changed = new.where("old <> component").limit(1).count()
        dropped(labels)
        labels = new.select("node", "component")
        if not changed:
            dropped(both)
            return labels
