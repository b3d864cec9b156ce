"""Totals over the hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolframe.functions.idset import encode


def subtree_totals(vertices: DataFrame, pairs: DataFrame, tracked: dict[str, list[str]]) -> DataFrame:
    """anchor, rtype, total: units of tracked types strictly below each anchor of a type.

    `tracked` maps anchors' types to types; "ALL" as a type stands for every anchor that
    isn't of the tracked type itself.
    """
    rules = [(a, t) for a, types in tracked.items() for t in types]
    below = vertices.where(F.col("type").isin(*{t for _, t in rules})).select(F.col("uniq_id").alias("desc"), F.col("type").alias("rtype"), "size")
    anchors = vertices.select(F.col("uniq_id").alias("anc"), F.col("type").alias("anchor_type"))
    summed = pairs.where("depth > 0").join(below, "desc").groupBy("anc", "rtype").agg(F.sum("size").alias("total")).join(anchors, "anc")
    wanted = F.lit(False)
    for a, t in rules:
        wanted = wanted | ((F.col("rtype") == t) & ((F.col("anchor_type") == a) if a != "ALL" else (F.col("anchor_type") != t)))
    return summed.where(wanted).select(F.col("anc").alias("anchor"), "rtype", "total")


def tracked_types(text: str) -> dict[str, list[str]]:
    """Anchors' types with the types that they track, from "anchor:type,...".

    What ALL tracks, no other anchor has to name.
    """
    out: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        anchor, given, kind = part.partition(":")
        if not given or not anchor or not kind or ":" in kind:
            raise ValueError(f"invalid rule: {part!r}")
        if kind not in out.setdefault(anchor, []):
            out[anchor].append(kind)
    every = out.get("ALL", [])
    return {a: kept for a, kinds in out.items() if (kept := [k for k in kinds if a == "ALL" or k not in every])}


def anchors_with(totals: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """anchor: those whose totals (anchor, rtype, total) are enough of every type; others needn't be searched below."""
    need = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    enough = totals.where(F.col("rtype").isin(*wanted)).where(F.col("total") >= need[F.col("rtype")])
    return enough.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("anchor")


def least_wanted(shapes: Sequence[dict[str, int]]) -> dict[str, int]:
    """What any of several shapes needs at least: of each type the least, and nothing of types that one shape is without."""
    common = set.intersection(*(set(shape) for shape in shapes))
    return {t: min(shape[t] for shape in shapes) for t in sorted(common)}


def subtree_usage(spans: DataFrame, vertices: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """anchor, rtype, used: units below each pool that spans hold at a time, those used at all."""
    held = spans.where((F.col("st") <= now) & (F.col("last") > now)).groupBy("uniq_id").agg(F.sum("planned").alias("used"))
    typed = held.join(vertices.select("uniq_id", F.col("type").alias("rtype")), "uniq_id").withColumnRenamed("uniq_id", "desc")
    return pairs.where("depth > 0").join(typed, "desc").groupBy(F.col("anc").alias("anchor"), "rtype").agg(F.sum("used").alias("used"))


def request_totals(requests: DataFrame, levels: int | None = None, most: int = 1000) -> DataFrame:
    """jobid, type, total: units that each job asks for at least, from rows (jobid, req, parent, type, cmin).

    A request below another counts once for each unit of it, level by level, until a level is empty; more than `most`
    are an error. With `levels`, the most below the outermost, nothing is run to find out, and deeper requests
    make the plan fail.
    """
    out = level = requests.where("parent IS NULL").select("jobid", "req", "type", F.col("cmin").alias("total"))

    def below(level: DataFrame) -> DataFrame:
        above = level.select("jobid", F.col("req").alias("parent"), F.col("total").alias("times"))
        return requests.join(above, ["jobid", "parent"]).select("jobid", "req", "type", (F.col("cmin") * F.col("times")).alias("total"))

    for _ in range(most if levels is None else levels):
        level = below(level)
        if levels is None and level.persist().isEmpty():
            break
        out = out.unionByName(level)
    else:
        if levels is None:
            raise ValueError(f"requests are nested deeper than {most} levels")
        too_deep = F.raise_error(F.concat(F.lit(f"requests are nested deeper than {levels} levels: "), F.col("total").cast("string"))).cast("bigint")
        out = out.unionByName(below(level).withColumn("total", too_deep))
    return out.groupBy("jobid", "type").agg(F.sum("total").alias("total"))


def rank_histogram(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """size, ranks: which ranks (compressed) have so many pools, nodes and what is below."""
    nodes = vertices.where("rank >= 0 AND type = 'node'").select(F.col("uniq_id").alias("anc"), "rank")
    sizes = pairs.join(nodes, "anc").groupBy("rank").agg(F.count("*").alias("size"))
    return encode(sizes, ["size"], "rank", "ranks")


def match_statistics(times: DataFrame, value: str, job: str, since: Column | None = None) -> DataFrame:
    """njobs, least, most, most_job, average, variance (of the population); the last two are 0 for one row.

    With a condition `since`, njobs_reset too: jobs after the counter was set to 0, which the other figures don't heed.
    """
    several = F.count("*") > 1
    counted = [] if since is None else [F.count_if(since).alias("njobs_reset")]
    return times.agg(
        F.count("*").alias("njobs"),
        *counted,
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        (-F.max(F.struct(F.col(value).alias("value"), (-F.col(job)).alias("job")))["job"]).alias("most_job"),
        F.when(several, F.avg(value)).otherwise(0.0).alias("average"),
        F.when(several, F.var_pop(value)).otherwise(0.0).alias("variance"),
    )
