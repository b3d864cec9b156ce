"""Ancestors and descendants in forests of pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, levels: int | None = None, most: int = 1000) -> DataFrame:
    """anc, desc, depth of every pair on a path down, a pool with itself at depth 0.

    Each level is an equi-join with the edges. Without `levels`, levels are made until one is empty; more than `most`
    are an error, as edges then run in a circle. With `levels`, the most that a forest has below its roots, the
    plan is known without running anything, and running it fails if there are more.
    """
    pairs = edges.select(F.col("src").alias("anc"), F.col("dst").alias("desc"), F.lit(1).alias("depth"))
    nodes = edges.select(F.col("src").alias("anc")).union(edges.select("dst")).distinct()
    out = nodes.select("anc", F.col("anc").alias("desc"), F.lit(0).alias("depth")).unionByName(pairs)
    step = edges.select(F.col("src").alias("desc"), F.col("dst").alias("below"))

    def below(pairs: DataFrame) -> DataFrame:
        return pairs.join(step, "desc").select("anc", F.col("below").alias("desc"), (F.col("depth") + 1).alias("depth"))

    if levels is not None:
        for _ in range(levels - 1):
            pairs = below(pairs)
            out = out.unionByName(pairs)
        # It names a column of either side, so no optimizer evaluates it before the join.
        too_deep = F.raise_error(F.concat(F.lit(f"pools are nested deeper than {levels} levels: "), F.col("anc").cast("string"), F.lit(" to "), F.col("desc").cast("string"))).cast("bigint")
        return out.unionByName(below(pairs).select(too_deep.alias("anc"), "desc", "depth"))
    for _ in range(most):
        pairs = below(pairs).persist()
        if pairs.isEmpty():
            return out
        out = out.unionByName(pairs)
    raise ValueError(f"pools are nested deeper than {most} levels, or in a circle")


def descendants(pairs: DataFrame, roots: DataFrame, with_self: bool = True) -> DataFrame:
    """Distinct uniq_id of all pools below those in `roots` (uniq_id)."""
    rows = pairs if with_self else pairs.where("depth > 0")
    return rows.join(roots.withColumnRenamed("uniq_id", "anc"), "anc", "left_semi").select(F.col("desc").alias("uniq_id")).distinct()


def ancestors(pairs: DataFrame, leaves: DataFrame, with_self: bool = True) -> DataFrame:
    """Distinct uniq_id of all pools above those in `leaves` (uniq_id)."""
    rows = pairs if with_self else pairs.where("depth > 0")
    return rows.join(leaves.withColumnRenamed("uniq_id", "desc"), "desc", "left_semi").select(F.col("anc").alias("uniq_id")).distinct()


def parents(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("uniq_id"), F.col("src").alias("parent"))
