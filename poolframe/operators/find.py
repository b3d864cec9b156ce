"""Searching pools by their own state and what they inherit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolframe.operators.closure import ancestors


def states(vertices: DataFrame, spans: DataFrame, pairs: DataFrame, now: int, jobs: Sequence[int] = ()) -> DataFrame:
    """The pools with down, allocated, reserved, alloc_jobs, reserve_jobs and tag_jobs.

    A pool is down, allocated or reserved if it or a pool above it is: allocations hold it at `now`, reservations
    begin later. Of `jobs`, those that criteria ask for, the arrays name those with such spans on the pool, and in
    tag_jobs those with any on it or below it: arrays are as long as the question, not as the history.
    """
    held = F.when((F.col("st") <= now) & (F.col("last") > now), "alloc").when(F.col("st") > now, "reserve")
    kinds = spans.select("uniq_id", "jobid", held.alias("kind")).where("kind IS NOT NULL")
    flags = kinds.groupBy("uniq_id").agg(F.bool_or(F.col("kind") == "alloc").alias("a"), F.bool_or(F.col("kind") == "reserve").alias("r"))
    none = F.array().cast("array<bigint>")
    own = vertices
    if jobs:
        asked = kinds.where(F.col("jobid").isin(*jobs))
        named = asked.groupBy("uniq_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("jobid"))).alias(f"{k}_jobs") for k in ("alloc", "reserve")])
        on = spans.where(F.col("jobid").isin(*jobs)).select(F.col("uniq_id").alias("desc"), "jobid").distinct()
        tags = pairs.join(on, "desc").groupBy(F.col("anc").alias("uniq_id")).agg(F.collect_set("jobid").alias("tag_jobs"))
        own = own.join(named, "uniq_id", "left").join(tags, "uniq_id", "left")
        own = own.withColumns({c: F.coalesce(c, none) for c in ("alloc_jobs", "reserve_jobs", "tag_jobs")})
    else:
        own = own.withColumns(dict.fromkeys(("alloc_jobs", "reserve_jobs", "tag_jobs"), none))
    flagged = vertices.join(flags, "uniq_id", "left").select(F.col("uniq_id").alias("anc"), (F.col("status") == "down").alias("d"), F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("r", F.lit(False)).alias("r")).where("d OR a OR r")
    inherited = pairs.join(flagged, "anc").groupBy(F.col("desc").alias("uniq_id")).agg(*[F.bool_or(c).alias(c) for c in "dar"])
    out = own.join(inherited, "uniq_id", "left")
    return out.select(*own.columns, *[F.coalesce(c, F.lit(False)).alias(n) for c, n in (("d", "down"), ("a", "allocated"), ("r", "reserved"))])


def find(stated: DataFrame, pairs: DataFrame, where: Column) -> DataFrame:
    """The pools that meet a condition and all above them, with `hit`: whether they meet it themselves."""
    hits = stated.where(where).select(F.col("uniq_id").alias("desc"))
    shown = pairs.join(hits, "desc").groupBy(F.col("anc").alias("uniq_id")).agg(F.bool_or(F.col("depth") == 0).alias("hit"))
    return stated.join(shown, "uniq_id")


def status_counts(stated: DataFrame) -> DataFrame:
    """type, all_n, down_n, allocated_n."""
    return stated.groupBy("type").agg(F.count("*").alias("all_n"), F.count_if("down").alias("down_n"), F.count_if("allocated").alias("allocated_n"))


def free_of(vertices: DataFrame, spans: DataFrame, pairs: DataFrame, st: int, last: int) -> DataFrame:
    """Pools that no span on them or below them overlaps [st, last): what may be had exclusively."""
    busy = spans.where((F.col("st") < last) & (F.col("last") > st)).select("uniq_id").distinct()
    return vertices.join(ancestors(pairs, busy), "uniq_id", "left_anti")


def usable(vertices: DataFrame, pairs: DataFrame, keep: Column) -> DataFrame:
    """Pools that meet a condition, and so do all above them: others are pruned with what is below."""
    bad = vertices.where(~keep).select(F.col("uniq_id").alias("anc"))
    lost = pairs.join(bad, "anc", "left_semi").select(F.col("desc").alias("uniq_id")).distinct()
    return vertices.join(lost, "uniq_id", "left_anti")
