"""Connected components of an edge table, by rounds of least-neighbour labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b: long): label is the least node of its component.

    Each round a node takes the least label among its neighbours' and its own, then its label's label. Labels stay in
    Spark; only whether any changed reaches the driver. Labels only ever fall, so rounds end.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    changed = bool(labels.limit(1).count())
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        taken = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = taken.join(of, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = stored(new, "labels")
        changed = bool(new.filter("label <> old").limit(1).count())
        labels = new.select("node", "label")
    return labels
