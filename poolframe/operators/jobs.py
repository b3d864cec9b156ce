"""Waiting lines of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the largest priority, from which keys count down.
MOST = 4294967295


def order() -> list[Column]:
    """High priority first, then early submission, then the smaller id."""
    return [(F.lit(MOST) - F.col("priority")).asc(), F.col("t_submit").asc(), F.col("jobid").asc()]


def lines(jobs: DataFrame, depth: int | None = None) -> DataFrame:
    """The jobs with `place` in their queue; with `depth` the first so many of each, dropped early."""
    placed = jobs.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(*order())))
    return placed if depth is None else placed.where(F.col("place") <= depth)


def windows(jobs: DataFrame, start: int, end: int) -> DataFrame:
    """Jobs (at, duration) with until and state: durations are rounded up, 0 lasts as long as the graph does.

    What would last beyond the graph's end is cut there; what begins then is busy, a negative duration invalid.
    """
    length = F.when(F.col("duration") == 0, F.lit(end - start)).otherwise(F.ceil("duration")).cast("bigint")
    state = F.when(F.col("duration") < 0, "invalid").when(F.col("at") >= end, "busy").otherwise("ok")
    return jobs.withColumns({"until": F.least(F.col("at") + length, F.lit(end).cast("bigint")), "state": state})


def info(spans: DataFrame, now: int) -> DataFrame:
    """jobid, state, at, until, pools: jobs that hold pools as `allocated`, those that will later as `reserved`, others as `done`."""
    each = spans.groupBy("jobid").agg(F.min("st").alias("at"), F.max("last").alias("until"), F.count_distinct("uniq_id").alias("pools"))
    state = F.when(F.col("at") > now, "reserved").when(F.col("until") > now, "allocated").otherwise("done")
    return each.select("jobid", state.alias("state"), "at", "until", "pools")


def counters(jobs: DataFrame, state: Column) -> DataFrame:
    """queue, state, jobs: how many jobs of each queue are in each state."""
    return jobs.groupBy("queue", state.alias("state")).agg(F.count("*").alias("jobs"))


def start_kind(reserved: Column, reservations: Column) -> Column:
    """How a job came to start: from a reservation, past others that have one, or at once."""
    return F.when(reserved, "reserved").when(reservations > 0, "backfill").otherwise("immediate")


def changed_estimates(estimates: DataFrame) -> DataFrame:
    """Of rows (jobid, round, estimate) those whose estimate differs from the round before; the first counts as changed."""
    turn = Window.partitionBy("jobid").orderBy("round")
    before = estimates.withColumns({"before": F.lag("estimate").over(turn), "n": F.row_number().over(turn)})
    return before.where((F.col("n") == 1) | ~F.col("estimate").eqNullSafe(F.col("before"))).drop("before", "n")
