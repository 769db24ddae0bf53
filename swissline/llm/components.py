"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swissline.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """v, label: the least vertex reachable from each vertex of links (a, b)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        target = lower.select(F.col("v").alias("new"), F.col("new").alias("jump"))
        step = materialize(lower.join(target, "new", "left").select("v", "old", F.coalesce("jump", "new").alias("label")), "labels")
        labels = step.select("v", "label")
        if step.filter("old <> label").isEmpty():
            return labels
