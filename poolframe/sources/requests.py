"""Nested requests of jobs, from JSON to rows."""

from __future__ import annotations

from itertools import product
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a request with exclusive choices stands for no more plain ones than these.
MOST_VARIANTS = 1000

_LEAF = "type: string, count: string, unit: string, exclusive: boolean, label: string"


def _schema(levels: int) -> str:
    inner = f"{_LEAF}, `with`: string"
    for _ in range(levels - 1):
        inner = f"{_LEAF}, `with`: array<struct<{inner}>>"
    return f"version int, resources array<struct<{inner}>>, attributes struct<system: struct<duration: double, queue: string>>"


def _counts(count: Column) -> list[Column]:
    """cmin, cmax, oper and operand of a count that is a number or a range."""
    number = count.try_cast("bigint")
    of = lambda name: F.get_json_object(count, f"$.{name}")
    least = F.coalesce(number, of("min").try_cast("bigint"))
    return [least.alias("cmin"), F.coalesce(number, of("max").try_cast("bigint")).alias("cmax"), F.coalesce(of("operator"), F.lit("+")).alias("oper"), F.coalesce(of("operand").try_cast("int"), F.lit(1)).alias("operand")]


def requests(jobs: DataFrame, text: str = "jobspec", levels: int = 4) -> DataFrame:
    """jobid, req, parent, depth, type, cmin, cmax, oper, operand, exclusive, label and duration of every request.

    `req` is the path of places from the outermost in. What is nested deeper than `levels`, text that isn't JSON
    and requests without a type or a smallest count bring no row: `rejected` names them. A duration is rounded up to whole seconds.
    """
    return _every(jobs, text, levels).where("type IS NOT NULL AND cmin IS NOT NULL").drop("deeper")


def rejected(jobs: DataFrame, text: str = "jobspec", levels: int = 4) -> DataFrame:
    """jobid, req, problem of what `requests` has no row for: text without requests, and requests at fault."""
    rows = _every(jobs, text, levels)
    reason = F.when(F.col("type").isNull(), "no type").when(F.col("cmin").isNull(), "no count").when(F.col("deeper"), "nested too deep")
    at_fault = rows.select("jobid", "req", reason.alias("problem")).where("problem IS NOT NULL")
    parsed = F.from_json(text, _schema(levels))
    empty = jobs.where(parsed["resources"].isNull() | (F.size(parsed["resources"]) == 0)).select("jobid", F.lit(None).cast("string").alias("req"), F.lit("no requests").alias("problem"))
    return at_fault.unionByName(empty)


def _every(jobs: DataFrame, text: str, levels: int) -> DataFrame:
    parsed = jobs.select("jobid", F.from_json(text, _schema(levels)).alias("j"))
    duration = F.ceil("j.attributes.system.duration").cast("bigint")
    level = parsed.select("jobid", duration.alias("duration"), F.lit(None).cast("string").alias("parent"), F.posexplode("j.resources").alias("place", "r"))
    out = None
    for depth in range(levels):
        req = F.concat_ws(".", F.col("parent"), F.col("place").cast("string"))
        rows = level.select("jobid", req.alias("req"), "parent", F.lit(depth).alias("depth"), F.col("r.type").alias("type"), *_counts(F.col("r.count")), F.col("r.exclusive").alias("exclusive"), F.col("r.label").alias("label"), "duration", (F.col("r.with").isNotNull() if depth == levels - 1 else F.lit(False)).alias("deeper"))
        out = rows if out is None else out.unionByName(rows)
        if depth < levels - 1:
            level = level.select("jobid", "duration", req.alias("parent"), F.posexplode("r.with").alias("place", "r"))
    return out


def problems(rows: DataFrame) -> DataFrame:
    """jobid, problem of requests that can't be met as they stand: bad ranges, or a type twice side by side."""
    ranges = rows.where("cmin < 1 OR cmax < cmin OR operand < 1 OR oper NOT IN ('+', '*', '^')").select("jobid", F.lit("count").alias("problem"))
    twice = rows.where("type != 'slot'").groupBy("jobid", "parent", "type").agg(F.count("*").alias("n")).where("n > 1").select("jobid", F.lit("repeated type").alias("problem"))
    return ranges.unionByName(twice).distinct()


def variants(request: list[dict[str, Any]]) -> list[list[dict[str, Any]]]:
    """The plain requests that one with exclusive choices (type xor_slot, at any depth) stands for, in the order to try them.

    Of choices side by side each variant has one, as a slot after what it stands beside. OverflowError if there are too many.
    """
    below = [(r, variants(r.get("with") or [])) for r in request]
    beside = [[r | {"with": v} if v else r for v in under] for r, under in below if r["type"] != "xor_slot"]
    choices = [[r | {"type": "slot", "with": v}] for r, under in below if r["type"] == "xor_slot" for v in under] or [[]]
    if prod(map(len, beside)) * len(choices) > MOST_VARIANTS:
        raise OverflowError(f"more than {MOST_VARIANTS} variants of a request")
    return [[*plain, *choice] for plain in product(*beside) for choice in choices]


def chain(request: list[dict[str, Any]]) -> list[tuple[str, int]]:
    """The levels (type, count) of a plain request that has one type at each; slots multiply what is in them."""
    out, times = [], 1
    while request:
        if len(request) > 1:
            raise ValueError("more than one type at a level")
        (r,), request = request, request[0].get("with") or []
        if r["type"] == "slot":
            times *= r.get("count", 1)
        else:
            out.append((r["type"], r.get("count", 1) * times))
            times = 1
    return out
