"""Connected components of an edge table, by DataFrame joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node it is connected to.

    Each round takes the smallest label of all neighbours, then the label of that label, so the
    rounds grow with the logarithm of the longest path. Every round is a stored table."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = stored(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "cc-labels")
        labels = new.select("node", "comp")
        if not new.filter("old <> comp").limit(1).count():
            return labels
