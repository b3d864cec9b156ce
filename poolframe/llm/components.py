"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolframe.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b): every node with the smallest node that it is connected to, as (node, label).

    Each round a node takes the smallest label of its neighbours, then the label of its
    label; rounds go on until none changes. Rounds are written to the shared folder, so a
    lost executor costs one round at most. Minima are summed up before they are shuffled,
    so a node with very many neighbours is no hot spot. Edges that are null on a side are
    left out; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        beyond = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = stored(hooked.join(beyond, "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        changed = after.where("label < was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
