"""Readers and writers by the names of their formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from poolframe.sources import readers, recipes, writers

#: Each takes a session and a path.
READERS: dict[str, Callable] = {
    "grug": lambda spark, path: recipes.expand(spark, *recipes.recipe(spark, path)),
    "jgf": readers.read_graphs,
    "rv1exec": lambda spark, path: readers.rank_graph(spark.read.schema(readers.RESOURCES).json(path)),
}
#: Each takes chosen pools (type, name, id, uniq_id, rank, size, status, path, properties, units, exclusive).
WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "simple": lambda chosen: chosen.select("uniq_id", writers.line(chosen["units"], chosen["exclusive"]).alias("line")),
    "pretty_simple": lambda chosen: chosen.select("uniq_id", writers.line(chosen["units"], chosen["exclusive"], long=True).alias("line")),
    "jgf": lambda chosen: chosen.select("uniq_id", writers.node_json(chosen["exclusive"]).alias("node")),
    "rlite": lambda chosen: writers.rank_lists(chosen.where("rank >= 0 AND type != 'node'").select("rank", "type", "id")),
}


def reader(name: str) -> Callable:
    if name not in READERS:
        raise ValueError(f"unknown format: {name!r}")
    return READERS[name]


def reader_of(uri: str) -> Callable:
    """The reader of what a scheduler's writer has left in a document, by that writer's name."""
    if uri in ("fluxion", "fluxion:jgf"):
        return reader("jgf")
    raise ValueError(f"unknown writer: {uri!r}")


def writer(name: str) -> Callable[[DataFrame], DataFrame]:
    """A writer by name; unknown names mean plain lines."""
    return WRITERS.get(name, WRITERS["simple"])
