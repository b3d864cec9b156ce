"""Conditions on pools as Columns: constraints of requests, and criteria of searches."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolframe.functions.idset import within

#: Fixed value: characters that no property may hold in a constraint.
INVALID = set("!&'\"^`|()")


def has_property(name: str, properties: Column | None = None) -> Column:
    """Whether a property is set; a leading ^ negates."""
    properties = F.col("properties") if properties is None else properties
    bare = name.removeprefix("^")
    if not bare or INVALID & set(bare):
        raise ValueError(f"invalid property: {name!r}")
    found = F.coalesce(F.map_contains_key(properties, F.lit(bare)), F.lit(False))
    return ~found if name.startswith("^") else found


def constraint(spec: dict[str, list] | None) -> Column:
    """A Column from {operator: [values]}: properties, hostlist, ranks, and, or, not.

    All of an operator's values must hold (one of an `or`); `not` is that not all do; an
    empty constraint holds.
    """
    if not spec:
        return F.lit(True)
    if len(spec) != 1:
        raise ValueError("a constraint has one operator")
    ((operator, values),) = spec.items()
    if not isinstance(values, list):
        raise ValueError(f"{operator}: a list is needed")
    if operator in ("and", "or", "not"):
        every = [constraint(v) for v in values]
        out = F.lit(operator != "or" or not every)
        for c in every:
            out = out | c if operator == "or" else out & c
        return ~out if operator == "not" else out
    if operator == "properties":
        out = F.lit(True)
        for v in values:
            out = out & has_property(v)
        return out
    if operator == "hostlist":
        return _any([within(F.col("name"), v) for v in values])
    if operator == "ranks":
        return _any([within(F.col("rank"), v) for v in values])
    raise ValueError(f"unknown operator: {operator}")


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def node_constraint(spec: dict[str, list] | None) -> Column:
    """The constraint for nodes and storage nodes; other types meet it."""
    return F.when(F.col("type").isin("node", "storage_node"), constraint(spec)).otherwise(True)


#: What a criterion says of a pool; `allocated`, `reserved` and the arrays of jobs are columns of `find.states`.
CRITERIA: dict[str, Callable[[str], Column]] = {
    "status": lambda v: F.col("down") if v == "down" else ~F.col("down"),
    "sched-now": lambda v: F.col("allocated") if v == "allocated" else ~F.col("allocated"),
    "sched-future": lambda v: F.col("reserved") if v == "reserved" else ~F.col("reserved"),
    "jobid-alloc": lambda v: F.array_contains("alloc_jobs", int(v)),
    "jobid-reserved": lambda v: F.array_contains("reserve_jobs", int(v)),
    "jobid-span": lambda v: F.array_contains("alloc_jobs", int(v)) | F.array_contains("reserve_jobs", int(v)),
    "jobid-tag": lambda v: F.array_contains("tag_jobs", int(v)),
    "names": lambda v: within(F.col("name"), v),
    "property": lambda v: F.map_contains_key("properties", F.lit(v.partition("=")[0])),
    "agfilter": lambda v: F.lit(v in ("t", "true")),
}
_VALUES = {"status": {"up", "down"}, "sched-now": {"allocated", "free"}, "sched-future": {"reserved", "free"}, "agfilter": {"t", "f", "true", "false"}}


def criterion(term: str) -> Column:
    key, given, value = term.partition("=")
    if key not in CRITERIA or not given or not value:
        raise ValueError(f"invalid criterion: {term!r}")
    value = value if key.startswith("jobid") else value.lower()
    if key in _VALUES and value not in _VALUES[key] or key.startswith("jobid") and not value.lstrip("-").isdigit():
        raise ValueError(f"invalid value: {term!r}")
    return CRITERIA[key](value)


def criteria(text: str) -> Column:
    """A Column from terms key=value with and, or and parentheses.

    Operators bind equally, from left to right; terms side by side are joined by `and`.
    """
    out: list[Column | None] = [None]
    pending = ["and"]
    tokens: Sequence[str] = re.findall(r"[()]|[^\s()]+", text)
    ready = False

    def put(column: Column) -> None:
        left = out[-1]
        out[-1] = column if left is None else (left | column if pending[-1] == "or" else left & column)
        pending[-1] = "and"

    for token in tokens:
        if token in ("and", "or"):
            if not ready:
                raise ValueError(f"nothing before {token!r}")
            pending[-1], ready = token, False
        elif token == "(":
            out.append(None)
            pending.append("and")
            ready = False
        elif token == ")":
            if len(out) == 1 or out[-1] is None or not ready:
                raise ValueError("unbalanced parentheses")
            inner = out.pop()
            pending.pop()
            put(inner)
        else:
            put(criterion(token))
            ready = True
    if len(out) != 1 or out[0] is None or not ready:
        raise ValueError(f"incomplete: {text!r}")
    return out[0]


def extract(text: str) -> list[tuple[str, str]]:
    """The terms of a text that is valid, as pairs; values in lower case, but those of jobs."""
    criteria(text)
    pairs = [t.split("=", 1) for t in re.findall(r"[^\s()]+", text) if "=" in t]
    return [(key, value if key.startswith("jobid") else value.lower()) for key, value in pairs]


def jobs_of(text: str) -> list[int]:
    """The jobs that criteria name: what `find.states` needs to know of spans."""
    return sorted({int(value) for key, value in extract(text) if key.startswith("jobid")})
