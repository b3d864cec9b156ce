"""Changes of state, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolframe.operators.closure import descendants


def cancel(spans: DataFrame, jobs: DataFrame) -> DataFrame:
    """The spans without those of `jobs` (jobid)."""
    return spans.join(jobs, "jobid", "left_anti")


def cancel_on(spans: DataFrame, pools: DataFrame, job: int | None = None) -> DataFrame:
    """The spans without those on `pools` (uniq_id), of one job or of all."""
    own = spans if job is None else spans.where(F.col("jobid") == job)
    gone = own.join(pools, "uniq_id", "left_semi").select("uniq_id", "jobid").distinct()
    return spans.join(gone, ["uniq_id", "jobid"], "left_anti")


def cancelled_fully(spans: DataFrame, pools: DataFrame) -> DataFrame:
    """jobid, n_cancelled, full: jobs with spans on `pools`, and whether they have none elsewhere."""
    marked = spans.join(pools.withColumn("gone", F.lit(True)), "uniq_id", "left")
    return marked.groupBy("jobid").agg(F.count_if("gone").alias("n_cancelled"), F.count("*").alias("n")).where("n_cancelled > 0").select("jobid", "n_cancelled", (F.col("n_cancelled") == F.col("n")).alias("full"))


def set_status(vertices: DataFrame, where: Column, status: str) -> DataFrame:
    return vertices.withColumn("status", F.when(where, F.lit(status)).otherwise(F.col("status")))


def rank_pools(vertices: DataFrame) -> DataFrame:
    """rank, uniq_id: of each rank the pool with the shortest path, of several the first."""
    return vertices.where("rank >= 0").groupBy("rank").agg(F.min(F.struct(F.length("path").alias("length"), "uniq_id"))["uniq_id"].alias("uniq_id"))


def set_property(vertices: DataFrame, where: Column, name: str, value: str = "") -> DataFrame:
    with_it = F.map_concat(F.map_filter("properties", lambda k, _: k != name), F.create_map(F.lit(name), F.lit(value)))
    return vertices.withColumn("properties", F.when(where, with_it).otherwise(F.col("properties")))


def remove_property(vertices: DataFrame, where: Column, name: str) -> DataFrame:
    return vertices.withColumn("properties", F.when(where, F.map_filter("properties", lambda k, _: k != name)).otherwise(F.col("properties")))


def graft(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """The pools with those of `new` whose path isn't taken yet."""
    return vertices.unionByName(new.join(vertices.select("path"), "path", "left_anti"), allowMissingColumns=True)


def prune(vertices: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pools without those in `roots` (uniq_id) and all below them."""
    return vertices.join(descendants(pairs, roots), "uniq_id", "left_anti")


def shrink(vertices: DataFrame, spans: DataFrame, pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pools and spans without what is at `roots` or below."""
    gone = descendants(pairs, roots)
    return vertices.join(gone, "uniq_id", "left_anti"), spans.join(gone, "uniq_id", "left_anti")


def conflicts(spans: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` (uniq_id, jobid, st, last) whose pool a span of another job holds meanwhile.

    Of the spans that begin before a row's end, the one that ends last decides, or if it is of the row's own job, the one
    of another job that ends last: both are running maxima, read once at each distinct end. Spans of a pool with
    equal times are one row with two of their jobs, so no span meets another in a join.
    """
    times = spans.where("st IS NOT NULL AND last IS NOT NULL").groupBy("uniq_id", "st", "last").agg(F.min("jobid").alias("a"), F.max("jobid").alias("b"))
    held = times.select("uniq_id", F.col("st").alias("tm"), "last", F.explode(F.array_distinct(F.array("a", "b"))).alias("jobid")).where("jobid IS NOT NULL")
    ends = new.where("last IS NOT NULL").select("uniq_id", F.col("last").alias("tm")).distinct()
    span = F.struct("last", "jobid")
    # Spans that begin at an end come after it.
    both = held.select("uniq_id", "tm", F.lit(1).alias("kind"), span.alias("span")).unionByName(ends.select("uniq_id", "tm", F.lit(0).alias("kind")), allowMissingColumns=True)
    turn = Window.partitionBy("uniq_id").orderBy("tm", "kind", "span")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    topped = both.withColumn("top", F.max("span").over(before))
    # What isn't the last to end, when a span of another job is: a job that comes to be the last has lost to none since.
    behind = F.when(F.col("top.jobid") != F.col("span.jobid"), F.least("top", "span"))
    read = topped.withColumn("second", F.max(behind).over(so_far)).where("kind = 0").select("uniq_id", F.col("tm").alias("last"), "top", "second")
    other = F.when(F.col("top.jobid") != F.col("jobid"), F.col("top.last")).otherwise(F.col("second.last"))
    return new.join(read, ["uniq_id", "last"]).where(F.col("jobid").isNotNull() & (other > F.col("st"))).select(*new.columns)


def apply(spans: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans with those of `new`, and jobid of jobs that are left out whole as one of their spans is in conflict."""
    refused = conflicts(spans, new).select("jobid").distinct()
    return spans.unionByName(new.join(refused, "jobid", "left_anti").select(*spans.columns)), refused


def commit(chosen: DataFrame, job: Column, st: int, duration: int) -> DataFrame:
    """The spans of a match: chosen pools (uniq_id, taken) are held by a job over [st, st + duration)."""
    return chosen.select("uniq_id", job.cast("bigint").alias("jobid"), F.lit(st).cast("bigint").alias("st"), F.lit(st + duration).cast("bigint").alias("last"), F.col("taken").alias("planned"))


def tags(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """uniq_id, jobid, planned: every pool on or above a job's spans, with the units that the job holds there and below."""
    held = spans.groupBy(F.col("uniq_id").alias("desc"), "jobid").agg(F.sum("planned").alias("planned"))
    return pairs.join(held, "desc").groupBy(F.col("anc").alias("uniq_id"), "jobid").agg(F.sum("planned").alias("planned"))


def promoted(children: DataFrame, taken: DataFrame) -> DataFrame:
    """parent: pools of which every child (parent, uniq_id) is in `taken` (uniq_id)."""
    marked = children.join(taken.select("uniq_id").distinct().withColumn("has", F.lit(True)), "uniq_id", "left")
    return marked.groupBy("parent").agg(F.count("*").alias("n"), F.count_if("has").alias("m")).where("n = m").select("parent")
