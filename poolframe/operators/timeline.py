"""Capacity over time: step functions of what remains of a pool, from the spans that hold it.

A pool is known by the columns `by`. Spans are half-open, [st, last). Points are where the
function may change: its start, and every start and end of a span. Spans' ends are summed up by
pool and time before any window, so a pool with very many spans brings one row per
time to its window.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BY = ("uniq_id",)


def usage(spans: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """by, tm, used: units in use from each time on until the next."""
    ends = spans.select(*by, F.inline(F.array(F.struct(F.col("st").alias("tm"), F.col("planned").alias("change")), F.struct(F.col("last").alias("tm"), (-F.col("planned")).alias("change")))))
    steps = ends.groupBy(*by, "tm").agg(F.sum("change").alias("change"))
    so_far = Window.partitionBy(*by).orderBy("tm").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, "tm", F.sum("change").over(so_far).alias("used"))


def peaks(spans: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """by, total: the most that a pool ever had in use."""
    return usage(spans, by).groupBy(*by).agg(F.max("used").alias("total"))


def peak_timeline(spans: DataFrame, by: Sequence[str] = BY, start: int = 0) -> DataFrame:
    """by, tm, remaining, total of every pool with spans, its total being the most that it ever had in use.

    Usage is summed once: the peak is taken over the same partition.
    """
    first = spans.select(*by).distinct().select(*by, F.lit(start).cast("bigint").alias("st"), F.lit(start).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("planned"))
    used = usage(spans.select(*first.columns).unionByName(first), by)
    total = F.max("used").over(Window.partitionBy(*by))
    return used.select(*by, "tm", (total - F.col("used")).alias("remaining"), total.alias("total"))


def peak_timelines(spans: DataFrame, kinds: Sequence[str], by: Sequence[str] = BY, start: int = 0) -> DataFrame:
    """by, tm and a column for each of `kinds`: what remains of the most that a pool ever had in use of it.

    Spans hold units of several kinds at once, in columns of these names. All kinds share their points, so a row
    has all of them, and spans are summed and sorted once, not for each kind.
    """
    first = spans.select(*by).distinct().select(*by, F.lit(start).cast("bigint").alias("tm"), *[F.lit(0).cast("bigint").alias(k) for k in kinds])
    ends = spans.select(*by, F.inline(F.array(F.struct(F.col("st").alias("tm"), *kinds), F.struct(F.col("last").alias("tm"), *[(-F.col(k)).alias(k) for k in kinds]))))
    steps = ends.unionByName(first).groupBy(*by, "tm").agg(*[F.sum(k).alias(k) for k in kinds])
    so_far = Window.partitionBy(*by).orderBy("tm").rowsBetween(Window.unboundedPreceding, 0)
    used = steps.select(*by, "tm", *[F.sum(k).over(so_far).alias(k) for k in kinds])
    return used.select(*by, "tm", *[(F.max(k).over(Window.partitionBy(*by)) - F.col(k)).alias(k) for k in kinds])


def timeline(spans: DataFrame, totals: DataFrame, by: Sequence[str] = BY, start: int = 0) -> DataFrame:
    """by, tm, remaining, total: for every pool in `totals`, those without spans too, the points from `start` on."""
    first = totals.select(*by, F.lit(start).cast("bigint").alias("st"), F.lit(start).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("planned"))
    used = usage(spans.select(*first.columns).unionByName(first), by)
    return used.join(totals, list(by)).select(*by, "tm", (F.col("total") - F.col("used")).alias("remaining"), "total")


def _floor(points: DataFrame, times: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, tm, value: that of the latest point not after each distinct time, null before the first.

    An as-of join as one union and one window, not a join of ranges. Times are made distinct first, so a pool
    that is asked about very often brings a row per time.
    """
    asked = times.select(*by, "tm").distinct()
    both = points.select(*by, "tm", F.col(value).alias("known"), F.lit(0).alias("kind")).unionByName(asked.select(*by, "tm", F.lit(1).alias("kind")), allowMissingColumns=True)
    until = Window.partitionBy(*by).orderBy("tm", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("known", ignorenulls=True).over(until)).where("kind = 1").select(*by, "tm", value)


def at(points: DataFrame, asked: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """`asked` (by, tm, ...) with remaining: that of the latest point not after tm, null before the first.

    Every row of `asked` is answered, repeated ones too.
    """
    return asked.join(_floor(points, asked, by, "remaining"), [*by, "tm"], "left").select(*asked.columns, "remaining")


def segments(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Points with `until`: where the next one is, null for the last."""
    return points.withColumn("until", F.lead("tm").over(Window.partitionBy(*by).orderBy("tm")))


#: The least over runs of 1, 2, 4 ... points is kept for so many powers of two.
RUNS = 16


#: Points are listed by stretches of so much time at least.
STRETCH = 32


def _within(points: DataFrame, asked: DataFrame, by: Sequence[str], longest: int) -> DataFrame:
    """`during` for windows of at most `longest`: points are listed by stretches of time that are no shorter, so a window
    lies in the one that it begins in and the next, and each question meets one row in an equi-join."""
    width = max(STRETCH, longest)
    begin = (F.col("tm") - F.pmod(F.col("tm"), F.lit(width).cast("bigint"))).alias("stretch")
    # Stretches that are asked about have a row without points, too.
    probes = asked.where("tm IS NOT NULL").select(*by, begin).distinct()
    rows = points.select(*by, begin, F.struct("tm", "remaining").alias("point")).unionByName(probes, allowMissingColumns=True)
    lists = rows.groupBy(*by, "stretch").agg(F.sort_array(F.collect_list("point")).alias("own"))
    turn = Window.partitionBy(*by).orderBy("stretch")
    final = F.get("own", F.size("own") - 1)["remaining"]
    table = lists.select(*by, "stretch", "own", F.last(final, ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.when(F.lead("stretch").over(turn) == F.col("stretch") + width, F.lead("own").over(turn)).alias("next"))
    end = F.col("tm") + F.col("duration")
    now = F.coalesce(F.array_max(F.filter("own", lambda x: x["tm"] <= F.col("tm")))["remaining"], F.col("carried"))
    ahead = [F.array_min(F.transform(F.filter(c, lambda x: (x["tm"] > F.col("tm")) & (x["tm"] < end)), lambda x: x["remaining"])) for c in ("own", "next")]
    too_long = F.raise_error(F.concat(F.lit(f"a window is longer than {longest}: "), F.col("duration").cast("string"))).cast("bigint")
    least = F.when(F.col("duration") > longest, too_long).when(F.col("duration") > 0, F.least(now, *ahead))
    return asked.withColumn("stretch", begin).join(table, [*by, "stretch"], "left").select(*asked.columns, least.alias("least"))


def during(points: DataFrame, asked: DataFrame, by: Sequence[str] = BY, longest: int | None = None) -> DataFrame:
    """`asked` (by, tm, duration, ...) with least: the least that remains over [tm, tm + duration).

    If no window is longer than `longest`, say so: points are then neither numbered nor multiplied. Longer ones fail.

    Every row of `asked` is answered, repeated ones too; pools without a point by then get null. Points are numbered, and the
    least over 1, 2, 4 ... points from each on is kept. A window is the points between two as-of reads, and two
    such runs cover them, or some more if it is longer than the longest run: so questions and points meet in equi-joins alone.
    """
    if longest is not None:
        return _within(points, asked, by, longest)
    turn = Window.partitionBy(*by).orderBy("tm")
    numbered = points.select(*by, "tm", F.col("remaining").alias("r0"), F.row_number().over(turn).alias("n"))
    for k in range(1, RUNS):
        # Past the last point nothing is lead to, and runs that would reach there are left out below.
        numbered = numbered.withColumn(f"r{k}", F.least(f"r{k - 1}", F.lead(f"r{k - 1}", 1 << (k - 1)).over(turn)))
    of_all = numbered.withColumn("points", F.count("*").over(Window.partitionBy(*by)))
    runs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("least")) for k in range(RUNS)]), lambda x: F.pow(F.lit(2.0), x["k"]) + F.col("n") - 1 <= F.col("points"))
    table = of_all.select(*by, "n", F.inline(runs))
    questions = asked.select(*by, "tm", "duration").distinct()
    ends = questions.select(*by, "tm").unionByName(questions.select(*by, (F.col("tm") + F.col("duration") - 1).alias("tm")))
    place = _floor(numbered, ends, by, "n")
    low = place.select(*by, "tm", F.col("n").alias("low"))
    high = place.select(*by, F.col("tm").alias("end"), F.col("n").alias("high"))
    placed = questions.withColumn("end", F.col("tm") + F.col("duration") - 1).join(low, [*by, "tm"]).join(high, [*by, "end"]).where("high IS NOT NULL AND duration > 0")
    length = F.col("high") - F.coalesce("low", F.lit(1)) + 1
    placed = placed.withColumns({"low": F.coalesce("low", F.lit(1)), "k": F.least(F.floor(F.log2(length.cast("double"))), F.lit(RUNS - 1)).cast("int")})
    step = F.pow(F.lit(2.0), F.col("k")).cast("int")
    last = F.col("high") - step + 1
    halves = placed.select(*by, "tm", "duration", "k", F.explode(F.array_distinct(F.concat(F.sequence("low", last, step), F.array(last)))).alias("n"))
    least = halves.join(table, [*by, "n", "k"]).groupBy(*by, "tm", "duration").agg(F.min("least").alias("least"))
    return asked.join(least, [*by, "tm", "duration"], "left").select(*asked.columns, "least")


def least_over(st: int, duration: int, value: str = "remaining") -> Column:
    """An aggregate of a pool's points: the least over [st, st + duration), null without a point by its end.

    For one window that all pools are asked about: a sum up of points, without numbering or joins.
    """
    if duration < 1:
        raise ValueError(f"a window of {duration} holds no time")
    tm = F.col("tm")
    return F.least(F.max_by(value, F.when(tm <= st, tm)), F.min(F.when((tm > st) & (tm < st + duration), F.col(value))))


def fits(points: DataFrame, duration: int, wanted: Column, after: int = 0, plan_end: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Points from `after` on at which `wanted` units remain for `duration`: by, tm, least.

    Only points are candidates, as times between them fit no earlier than the point before.
    """
    ahead = Window.partitionBy(*by).orderBy("tm").rangeBetween(0, duration - 1)
    out = points.withColumn("least", F.min("remaining").over(ahead)).where((F.col("tm") >= after) & (F.col("least") >= wanted))
    return out if plan_end is None else out.where(F.col("tm") + duration <= plan_end)


def first_fit(points: DataFrame, duration: int, wanted: Column, after: int = 0, plan_end: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """by, tm: the earliest fit of each pool; pools without one are left out."""
    return fits(points, duration, wanted, after, plan_end, by).groupBy(*by).agg(F.min("tm").alias("tm"))


def next_fits(points: DataFrame, duration: int, wanted: Column, n: int, after: int = 0, by: Sequence[str] = BY) -> DataFrame:
    """by, place, tm: the first `n` fits of each pool in turn."""
    turn = Window.partitionBy(*by).orderBy("tm")
    return fits(points, duration, wanted, after, None, by).withColumn("place", F.row_number().over(turn)).where(F.col("place") <= n).select(*by, "place", "tm")


def fits_all(points: DataFrame, duration: int, wanted: dict[str, int], after: int = 0, by: Sequence[str] = BY, kind: str = "rtype") -> DataFrame:
    """by, tm: times at which enough of every type remains; the first type's points are candidates.

    Spans put points on all types' timelines, so the others' least over the window is read at
    the same times, and no range is joined.
    """
    first = next(iter(wanted))
    need = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col(kind)]
    ahead = Window.partitionBy(*by, kind).orderBy("tm").rangeBetween(0, duration - 1)
    tested = points.where(F.col(kind).isin(*wanted)).withColumn("enough", F.min("remaining").over(ahead) >= need)
    at_once = tested.where(F.col("tm") >= after).groupBy(*by, "tm").agg(F.count_if("enough").alias("n"), F.bool_or(F.col(kind) == first).alias("candidate"))
    return at_once.where(F.col("candidate") & (F.col("n") == len(wanted))).select(*by, "tm")


def fits_at_once(points: DataFrame, duration: int, wanted: dict[str, int], after: int = 0, by: Sequence[str] = BY) -> DataFrame:
    """by, tm: as `fits_all`, of points that have a column for each kind (`peak_timelines`): one window answers for all."""
    ahead = Window.partitionBy(*by).orderBy("tm").rangeBetween(0, duration - 1)
    ahead_of = points.where(F.col("tm") >= after).select(*by, "tm", *[F.min(k).over(ahead).alias(k) for k in wanted])
    enough = F.lit(True)
    for k, n in wanted.items():
        enough = enough & (F.col(k) >= n)
    return ahead_of.where(enough).select(*by, "tm")


#: So many stretches of a pool in which new spans overlap are tried by one call.
BUNDLE = 64


def add_spans(spans: DataFrame, points: DataFrame, new: DataFrame, by: Sequence[str] = BY, kind: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    """The spans with those of `new` (by, jobid, st, last, planned) that fit, each beside those added before it.

    New spans are tried in order of jobid, st and last in each pool. What fits even if all new ones are added needs no
    order and is added at once. The others are tried in turn by tasks that take a pool and some stretches of time
    in which they overlap, as in other stretches they don't meet. `longest` is what `during` makes of it.

    With `kind` (columns of `by`, such as the type of units) the rows of a job with equal st and last are one span over several
    kinds: it is added with all of them or not at all.
    """
    pool = [c for c in by if c not in kind]
    who = [*pool, "jobid", "st", "last"]
    change = F.inline(F.array(F.struct(F.col("st").alias("tm"), F.col("planned").alias("change")), F.struct(F.col("last").alias("tm"), (-F.col("planned")).alias("change"))))
    steps = points.select(*by, "tm", (-F.col("remaining") + F.lag("remaining", 1, 0).over(Window.partitionBy(*by).orderBy("tm"))).alias("change"))
    both = steps.unionByName(new.select(*by, change)).groupBy(*by, "tm").agg(F.sum("change").alias("change"))
    crowded = both.select(*by, "tm", (-F.sum("change").over(Window.partitionBy(*by).orderBy("tm"))).alias("remaining"))
    asked = new.select(*by, "jobid", "st", "last", "planned", F.col("st").alias("tm"), (F.col("last") - F.col("st")).alias("duration"))
    tested = during(crowded, asked, by, longest).withColumn("fits", F.coalesce(F.col("least") >= 0, F.lit(False)))
    # Read five times below: kept while it is needed, and made again if an executor is lost.
    tested = tested.withColumn("fits", F.min("fits").over(Window.partitionBy(*who))).persist()
    sure, open_ = tested.where("fits"), tested.where("NOT fits")
    # Stretches: a span begins one if all before it in its pool have ended.
    before = Window.partitionBy(*pool).orderBy("st", "last", "jobid").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("st") >= F.coalesce(F.max("last").over(before), F.col("st"))
    spans_of = open_.select(*who).distinct().withColumn("fresh", fresh.cast("int"))
    stretches = spans_of.withColumn("stretch", F.floor(F.sum("fresh").over(Window.partitionBy(*pool).orderBy("st", "last", "jobid")) / BUNDLE)).drop("fresh")
    limits = stretches.groupBy(*pool, "stretch").agg(F.min("st").alias("from"), F.max("last").alias("to"))
    base = steps.unionByName(sure.select(*by, change)).groupBy(*by, "tm").agg(F.sum("change").alias("change"))
    base = segments(base.select(*by, "tm", (-F.sum("change").over(Window.partitionBy(*by).orderBy("tm"))).alias("remaining")), by)
    within = base.join(limits, pool).where(F.col("tm") < F.col("to")).where(F.col("until").isNull() | (F.col("until") > F.col("from")))
    schema = open_.select(*by, "jobid", "st", "last", "planned").schema
    level = within.select(*[F.col(c).alias(c) for c in (*by, "stretch", "tm", "remaining")]).groupBy(*pool, "stretch")
    tried = open_.join(stretches, who).select(*[F.col(c).alias(c) for c in (*by, "jobid", "st", "last", "planned", "stretch")]).groupBy(*pool, "stretch").cogroup(level).applyInPandas(lambda a, b: _in_turn(a, b, list(kind), schema.names), schema)
    return spans.unionByName(sure.select(*schema.names).unionByName(tried).select(*spans.columns))


def _in_turn(new: pd.DataFrame, levels: pd.DataFrame, kind: list[str], names: list[str]) -> pd.DataFrame:
    """The rows of one pool's new spans that fit, tried in turn, over what remains by time."""
    times = np.unique(np.concatenate([levels["tm"], new["st"], new["last"]]))
    left: dict[tuple, np.ndarray] = {}
    for key, part in levels.groupby(kind) if kind else [((), levels)]:
        part = part.sort_values("tm")
        at = np.searchsorted(part["tm"].to_numpy(), times, "right") - 1
        left[key] = np.where(at >= 0, part["remaining"].to_numpy()[np.maximum(at, 0)], 0)
    new = new.sort_values(["jobid", "st", "last"], kind="stable")
    kinds = list(zip(*(new[c].tolist() for c in kind), strict=True)) if kind else [()] * len(new)
    rows = zip(*(new[c].tolist() for c in ("jobid", "st", "last")), kinds, new["planned"].tolist(), strict=True)
    taken: list[bool] = []
    for (_, st, last), same in groupby(rows, key=lambda r: r[:3]):
        low, high = np.searchsorted(times, [st, last])
        need: dict[tuple, int] = {}
        n_rows = 0
        for *_, key, n in same:
            need[key] = need.get(key, 0) + n
            n_rows += 1
        fits = all(key in left and (low == high or left[key][low:high].min() >= n) for key, n in need.items())
        for key, n in need.items() if fits else ():
            left[key][low:high] -= n
        taken += [fits] * n_rows
    return new[names][np.array(taken, bool)]


def remove_spans(spans: DataFrame, gone: DataFrame, on: Sequence[str] = ("jobid",)) -> DataFrame:
    return spans.join(gone, list(on), "left_anti")


def reduce_spans(spans: DataFrame, less: DataFrame, on: Sequence[str] = ("jobid",)) -> DataFrame:
    """Spans with `less` (on, units) taken off; those left with nothing go, larger reductions than the span's are not made."""
    joined = spans.join(less, list(on), "left").withColumn("units", F.coalesce("units", F.lit(0)))
    left = F.when(F.col("units") > F.col("planned"), F.col("planned")).otherwise(F.col("planned") - F.col("units"))
    return joined.withColumn("planned", left).where("planned > 0").select(*spans.columns)


def change_totals(points: DataFrame, change: Column) -> DataFrame:
    """Points after each pool's total went up or down by `change`; nothing goes below 0."""
    return points.withColumn("remaining", F.greatest(F.col("remaining") + change, F.lit(0))).withColumn("total", F.greatest(F.col("total") + change, F.lit(0)))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same points, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def earliest_for_many(points: DataFrame, groups: DataFrame, wanted: int, duration: int, members: int, after: int = 0) -> DataFrame:
    """grp, tm: when first, from `after` on, `wanted` units remain for `duration` in `members` pools of a group at once.

    `groups` has uniq_id and grp. Where too little remains, a pool can't be had from `duration` before until the
    end; these times are merged for each pool and counted for each group by a running sum, so no pool's times
    meet another's in a join.
    """
    short = segments(points).where(F.col("remaining") < wanted).join(groups, "uniq_id")
    closed = short.select("grp", "uniq_id", (F.col("tm") - duration + 1).alias("low"), F.coalesce("until", F.lit(1 << 60)).alias("high"))
    before = Window.partitionBy("uniq_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    island = F.sum(F.when(F.col("low") > F.col("reach"), 1).otherwise(0)).over(Window.partitionBy("uniq_id").orderBy("low", "high"))
    merged = closed.withColumn("reach", F.max("high").over(before)).withColumn("island", island).groupBy("grp", "uniq_id", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    steps = merged.select("grp", F.inline(F.array(F.struct(F.col("low").alias("tm"), F.lit(1).alias("change")), F.struct(F.col("high").alias("tm"), F.lit(-1).alias("change")))))
    steps = steps.unionByName(sizes.select("grp", F.lit(after).cast("bigint").alias("tm"), F.lit(0).alias("change"))).groupBy("grp", "tm").agg(F.sum("change").alias("change"))
    closed_at = steps.withColumn("closed", F.sum("change").over(Window.partitionBy("grp").orderBy("tm")))
    return closed_at.join(sizes, "grp").where((F.col("tm") >= after) & (F.col("n") - F.col("closed") >= members)).groupBy("grp").agg(F.min("tm").alias("tm"))
