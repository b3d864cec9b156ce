"""Which pools meet a nested request: a plan for each level, from the leaves up.

A request is a list of levels from the outermost in: (type, how many). What a level needs of the
next is counted with its parent, so each level is an equi-join, a window and an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from poolframe.operators.closure import ancestors
from poolframe.operators.policy import best, bundles
from poolframe.operators.rollup import subtree_totals


def free_units(vertices: DataFrame, spans: DataFrame, st: int, duration: int) -> DataFrame:
    """Pools with free: the units of their size that no span holds at any time of the window."""
    held = spans.where((F.col("st") < st + duration) & (F.col("last") > st)).groupBy("uniq_id").agg(F.sum("planned").alias("held"))
    return vertices.join(held, "uniq_id", "left").withColumn("free", F.greatest(F.col("size") - F.coalesce("held", F.lit(0)), F.lit(0))).drop("held")


def match(pools: DataFrame, edges: DataFrame, request: Sequence[tuple[str, int]], order: Sequence[Column], amount: str = "free") -> DataFrame:
    """level, uniq_id, parent, taken of the pools chosen, or no rows if the request can't be met.

    The innermost type is asked for in units of `amount`, the others in pools that have
    enough below them. The first level may stand at any depth; each further one is a direct
    child. `order` ranks candidates and must be total.
    """
    up = edges.select(F.col("dst").alias("uniq_id"), F.col("src").alias("parent"))
    placed = pools.join(up, "uniq_id", "left")
    able: DataFrame | None = None
    levels: list[DataFrame] = []
    for kind, need in reversed(request):
        here = placed.where(F.col("type") == kind)
        if able is None:
            here = here.withColumn("amount", F.col(amount).cast("bigint"))
        else:
            here = here.join(able, "uniq_id", "left_semi").withColumn("amount", F.lit(1).cast("bigint"))
        here = here.where("amount > 0")
        by = ["parent"]
        if len(levels) == len(request) - 1:
            # The whole graph answers for the outermost level. Every candidate gives one at least, so the first
            # `need` are enough: tasks keep so many each, and no window sees the others.
            by, here = [], here.orderBy(*order).limit(need)
        # The level above reads it, and so does the way back down: it is kept, and made again if lost.
        chosen = best(here, F.lit(need), by, order).select("uniq_id", "parent", "taken").persist()
        levels.append(chosen)
        able = chosen.select(F.col("parent").alias("uniq_id")).distinct()
    out: DataFrame | None = None
    above: DataFrame | None = None
    for n, chosen in enumerate(reversed(levels)):
        if above is not None:
            chosen = chosen.join(above.select(F.col("uniq_id").alias("parent")), "parent", "left_semi")
        rows = chosen.select(F.lit(n).alias("level"), "uniq_id", "parent", "taken")
        out = rows if out is None else out.unionByName(rows)
        above = chosen
    return out


def feasible_nodes(pools: DataFrame, keep: Column, free: str = "free") -> DataFrame:
    """One row: how many nodes are up, meet a condition and are free."""
    return pools.where((F.col("type") == "node") & (F.col("status") == "up") & keep & (F.col(free) > 0)).agg(F.count("*").alias("nodes"))


def slots(children: DataFrame, shape: dict[str, int], by: Sequence[str] = ("parent",)) -> DataFrame:
    """by, slots: how many slots of a shape (type to units) the children (by, type, id, amount) of a pool make.

    Children are taken whole in order of ids; a type that is missing makes none.
    """
    need = F.create_map(*[F.lit(x) for pair in shape.items() for x in pair])
    lists = children.where(F.col("type").isin(*shape)).groupBy(*by, "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "amount"))), lambda x: x["amount"]).alias("amounts"))
    made = lists.withColumn("made", bundles(F.col("amounts"), need[F.col("type")]))
    return made.groupBy(*by).agg(F.min("made").alias("least"), F.count("*").alias("types")).select(*by, F.when(F.col("types") == len(shape), F.col("least")).otherwise(0).alias("slots"))


def either(made: Sequence[DataFrame], by: Sequence[str] = ("parent",)) -> DataFrame:
    """by, variant, slots: the first of several shapes' counts that gives any slot, for each pool."""
    rows = None
    for n, df in enumerate(made):
        part = df.where("slots > 0").withColumn("variant", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*by).agg(F.min(F.struct("variant", "slots")).alias("first")).select(*by, "first.variant", "first.slots")


def assembled(children: DataFrame, shape: dict[str, int], by: Sequence[str] = ("parent",)) -> DataFrame:
    """by, slot, type, id, amount: the slots that `slots` counts, numbered from 0, each with the children that it takes whole.

    Children that are over, and those of slots that some type can't fill, are left out; so are children without an amount. A task
    reads a pool's children of a type in order and remembers two numbers, so pools with very many are not held in memory.
    """
    names = [*by, "type", "id", "amount"]
    kept = children.where(F.col("type").isin(*shape) & (F.col("amount") > 0)).select(*[F.col(c).alias(c) for c in names])
    group = [*by, "type"]
    schema = StructType([*kept.schema.fields, StructField("slot", LongType())])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, slot, held = None, 0, 0
        for batch in batches:
            places = []
            for *key, amount in zip(*(batch[c].tolist() for c in (*group, "amount")), strict=True):
                if key != at:
                    at, slot, held = key, 0, 0
                places.append(slot)
                held += amount
                if held >= shape[key[-1]]:
                    slot, held = slot + 1, 0
            yield batch.assign(slot=pd.Series(places, index=batch.index, dtype="int64"))

    placed = kept.repartition(*group).sortWithinPartitions(*group, "id", "amount").mapInPandas(fill, schema)
    full = placed.groupBy(*by, "slot").agg(*[F.coalesce(F.sum(F.when(F.col("type") == t, F.col("amount"))), F.lit(0)).alias(f"of_{n}") for n, t in enumerate(shape)])
    for n, least in enumerate(shape.values()):
        full = full.where(F.col(f"of_{n}") >= least)
    return placed.join(full.select(*by, "slot"), [*by, "slot"], "left_semi").select(*by, "slot", "type", "id", "amount")


def mixed_slots(units: DataFrame, shapes: Sequence[dict[str, int]], by: Sequence[str] = ("parent",)) -> DataFrame:
    """by, slots: the most slots that units (by, type, amount) make, each of any of several shapes.

    For every number of each shape but the last that there is enough for, what is left decides on the
    last; amounts can be cut freely.
    """
    if not shapes or not all(shape and min(shape.values()) > 0 for shape in shapes):
        raise ValueError("a shape needs at least one type, and at least one unit of each")
    types = sorted({t for shape in shapes for t in shape})
    sums = units.where(F.col("type").isin(*types)).groupBy(*by).agg(*[F.sum(F.when(F.col("type") == t, F.col("amount")).otherwise(0)).cast("bigint").alias(f"has_{n}") for n, t in enumerate(types)])

    def most(left: dict[str, Column], shapes: Sequence[dict[str, int]]) -> Column:
        shape, *others = shapes
        fit = [F.floor(left[t] / n) for t, n in shape.items()]
        made = F.least(*fit) if len(fit) > 1 else fit[0]
        if not others:
            return made
        return F.array_max(F.transform(F.sequence(F.lit(0).cast("bigint"), made), lambda i: i + most({t: has - i * shape.get(t, 0) for t, has in left.items()}, others)))

    return sums.select(*by, most({t: F.col(f"has_{n}") for n, t in enumerate(types)}, shapes).alias("slots"))


def match_either(pools: DataFrame, edges: DataFrame, variants: Sequence[Sequence[tuple[str, int]]], order: Sequence[Column], amount: str = "free") -> DataFrame:
    """variant and the rows of `match` for the first of several requests that can be met, or no rows if none can."""
    rows = None
    for n, request in enumerate(variants):
        part = match(pools, edges, request, order, amount).select(F.lit(n).alias("variant"), "level", "uniq_id", "parent", "taken")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(rows.agg(F.min("variant").alias("variant")), "variant", "left_semi")


def able(amounts: DataFrame, needs: DataFrame) -> DataFrame:
    """need, able: of distinct needs (need), how many pools have an amount (amount) of at least so much.

    Pools are counted by amount first, so the one window over all of them has as many rows as there are
    different amounts and needs.
    """
    had = amounts.groupBy(F.col("amount").cast("bigint").alias("at")).agg(F.count("*").alias("n"))
    asked = needs.select(F.col("need").cast("bigint").alias("at")).distinct()
    both = had.select("at", "n", F.lit(False).alias("asked")).unionByName(asked.select("at", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked")))
    # Of equal ones the pools come first: what is asked for may be just met.
    down = Window.orderBy(F.col("at").desc(), F.col("asked")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("able", F.sum("n").over(down)).where("asked").select(F.col("at").alias("need"), "able")


def outcomes(requests: DataFrame, now: DataFrame, ever: DataFrame) -> DataFrame:
    """jobid, outcome of requests (jobid, count, need) for so many pools with so much each below them.

    `matched` if enough pools have it now, else `busy` if they would were all of them up and free, else `impossible`.
    `now` and `ever` are the pools' amounts (amount).
    """
    asked = requests.withColumn("need", F.col("need").cast("bigint"))
    counted = able(now, asked).withColumnRenamed("able", "n").join(able(ever, asked).withColumnRenamed("able", "m"), "need")
    outcome = F.when(F.col("n") >= F.col("count"), "matched").when(F.col("m") >= F.col("count"), "busy").otherwise("impossible")
    return asked.join(counted, "need").select("jobid", outcome.alias("outcome"))


def pruned(pools: DataFrame, pairs: DataFrame, keep: Column, need: int, busy: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """uniq_id, reason: why a search leaves each pool (uniq_id, type, status, free) and what is below, null for those it enters.

    In this order: `status`, `constraint` if `keep` doesn't hold, `availability` with less than `need` free, `exclusivity` if the
    pool or one below is in `busy` (uniq_id), `subtree` if less of a wanted type is free below it than wanted; pools with
    nothing of such a type below aren't asked. What is below a pool that is left has the reason `above`.
    """
    held = ancestors(pairs, busy).withColumn("held", F.lit(True))
    wants = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    totals = subtree_totals(pools.drop("size").withColumnRenamed("free", "size"), pairs, {"ALL": list(wanted)})
    short = totals.where(F.col("total") < wants[F.col("rtype")]).select(F.col("anchor").alias("uniq_id"), F.lit(True).alias("short")).distinct()
    marked = pools.join(held, "uniq_id", "left").join(short, "uniq_id", "left")
    own = F.when(F.col("status") != "up", "status").when(~F.coalesce(keep, F.lit(False)), "constraint").when(F.col("free") < need, "availability").when(F.col("held"), "exclusivity").when(F.col("short"), "subtree")
    reasons = marked.select("uniq_id", own.alias("own"))
    left = reasons.where("own IS NOT NULL").select(F.col("uniq_id").alias("anc"))
    under = pairs.where("depth > 0").join(left, "anc", "left_semi").select(F.col("desc").alias("uniq_id"), F.lit("above").alias("above")).distinct()
    return reasons.join(under, "uniq_id", "left").select("uniq_id", F.coalesce("above", "own").alias("reason"))


def supported(pools: DataFrame, pairs: DataFrame, amounts: DataFrame, need: int) -> DataFrame:
    """The pools all of whose ancestors in another subsystem, by its `pairs`, have at least `need` (uniq_id, amount).

    An ancestor without an amount gives nothing; pools that the subsystem doesn't hold aren't asked of it.
    """
    given = amounts.select(F.col("uniq_id").alias("anc"), "amount")
    poor = pairs.where("depth > 0").join(given, "anc", "left").where(F.coalesce("amount", F.lit(0)) < need).select(F.col("desc").alias("uniq_id")).distinct()
    return pools.join(poor, "uniq_id", "left_anti")
