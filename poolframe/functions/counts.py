"""Numbers of units that a request may take, and numbers out of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(least: Column, most: Column, operator: Column, operand: Column, qualified: Column) -> Column:
    """The largest number of a series that is not above `most` or `qualified`, 0 if none is.

    It begins at `least`; + adds the operand, * multiplies by it, ^ takes the power of it. A
    series that stands still is its beginning. Closed forms: nothing is counted up.
    """
    bound = F.least(most, qualified)
    added = least + F.floor((bound - least) / operand) * operand
    # Logarithms are rounded, so the neighbours of what they give are tried as well.
    times = F.floor(F.log(bound / least) / F.log(operand.cast("double")))
    power = F.floor(F.log(F.log(bound.cast("double")) / F.log(least.cast("double"))) / F.log(operand.cast("double")))

    def best(exponent: Column, value) -> Column:
        tried = [value(exponent + d) for d in (-1, 0, 1)]
        return F.greatest(*[F.when((t <= bound) & (t >= least), t) for t in tried], least)

    multiplied = best(times, lambda e: F.round(least * F.pow(operand, e)).cast("bigint"))
    raised = best(power, lambda e: F.round(F.pow(least.cast("double"), F.pow(operand, e))).cast("bigint"))
    value = (
        F.when((operator == "+") & (operand >= 1), added)
        .when((operator == "*") & (operand >= 2) & (least >= 1), multiplied)
        .when((operator == "^") & (operand >= 2) & (least >= 2), raised)
        .otherwise(least)
    )
    return F.when((least > most) | (least > qualified), 0).otherwise(value).cast("bigint")


def host_number(name: Column) -> Column:
    """The digits that a name ends in, as a number; -1 without any."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits == "", -1).otherwise(digits.cast("bigint")).cast("bigint")


def path_above(path: Column, levels: int) -> Column:
    """The path without its last `levels` names; null where it has no more than that."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) - 1 > levels, F.array_join(F.slice(parts, 1, F.size(parts) - levels), "/"))
