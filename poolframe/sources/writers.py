"""Chosen pools as lines, as graphs in JSON, and as lists of what ranks hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolframe.functions.idset import encode


def line(needs: Column, exclusive: Column, long: bool = False) -> Column:
    """name[units:x or s], indented by the depth of the path; with `long` the mode is a word."""
    depth = F.size(F.split("path", "/")) - 2
    return F.concat(F.repeat(F.lit("   "), depth), F.col("name"), F.lit("["), needs.cast("string"), F.lit(":"), F.when(exclusive, "exclusive" if long else "x").otherwise("shared" if long else "s"), F.lit("]"))


def sort_key(depth_first: bool = False) -> Column:
    """What orders pools root first; with `depth_first`, a pool after all below it."""
    return F.concat("path", F.lit("~")) if depth_first else F.col("path")


def node_json(exclusive: Column | None = None) -> Column:
    """A vertex of a graph in JSON; fields that follow from others, or have their default, are left out."""
    derived = F.concat("type", F.col("id").cast("string"))
    metadata = F.struct(
        "type",
        F.when(F.col("name") != derived, F.col("name")).alias("name"),
        F.col("id").alias("id"),
        "uniq_id",
        F.col("rank").alias("rank"),
        F.when(F.col("status") != "up", F.col("status")).alias("status"),
        (F.when(exclusive, True) if exclusive is not None else F.lit(None).cast("boolean")).alias("exclusive"),
        F.when(F.col("size") != 1, F.col("size")).alias("size"),
        F.create_map(F.lit("containment"), F.col("path")).alias("paths"),
        F.when(F.size("properties") > 0, F.col("properties")).alias("properties"),
    )
    return F.struct(F.col("uniq_id").cast("string").alias("id"), metadata.alias("metadata"))


def edge_json() -> Column:
    """An edge; its metadata is there for other subsystems than containment only."""
    other = F.when(F.col("subsystem") != "containment", F.struct("subsystem"))
    return F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), other.alias("metadata"))


def write_graphs(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines, each a graph of one vertex or edge: tasks write their own, and splits can be read."""
    nodes = vertices.select(F.struct(F.array(node_json()).alias("nodes")).alias("graph"))
    links = edges.select(F.struct(F.array(edge_json()).alias("edges")).alias("graph"))
    nodes.write.json(path)
    links.write.mode("append").json(path)


def without_implied(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """Chosen pools (uniq_id, exclusive) without those whose parent is exclusive."""
    up = edges.select(F.col("dst").alias("uniq_id"), F.col("src").alias("parent"))
    whole = chosen.where("exclusive").select(F.col("uniq_id").alias("parent"))
    implied = up.join(whole, "parent", "left_semi").select("uniq_id")
    return chosen.join(implied, "uniq_id", "left_anti")


def rank_lists(units: DataFrame) -> DataFrame:
    """ranks, children of units (rank, type, id): ranks with the same children share a row, all compressed."""
    ids = encode(units, ["rank", "type"], "id", "ids")
    children = ids.groupBy("rank").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "type", "ids"))), " ").alias("children"))
    return encode(children, ["children"], "rank", "ranks")


def property_ranks(vertices: DataFrame) -> DataFrame:
    """property, ranks: which ranks have a property, as name or name=value."""
    each = vertices.where("rank >= 0").select("rank", F.explode("properties").alias("name", "value"))
    named = each.select("rank", F.when(F.col("value") == "", F.col("name")).otherwise(F.concat_ws("=", "name", "value")).alias("property"))
    return encode(named, ["property"], "rank", "ranks")


def resources(lists: DataFrame, start: int, expiration: int, hosts: DataFrame | None = None, properties: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """One row with the JSON of rank lists (ranks, children): as many entries as there are kinds of nodes.

    With hosts (rank, host), properties (property, ranks) and a graph (one row, graph: JSON) it names these too. The
    text is one value, so what goes in is a match, not a machine room.
    """
    pairs = F.transform(F.split("children", " "), lambda c: F.struct(F.substring_index(c, "=", 1).alias("k"), F.substring_index(c, "=", -1).alias("v")))
    entry = F.struct(F.col("ranks").alias("rank"), F.map_from_entries(pairs).alias("children"))
    entries = lists.agg(F.collect_list(entry).alias("R_lite"))
    fields = ["R_lite"]
    if hosts is not None:
        listed = hosts.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "host"))), lambda x: x["host"]).alias("nodelist"))
        entries, fields = entries.join(F.broadcast(listed)), [*fields, "nodelist"]
    if properties is not None:
        named = properties.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "ranks")))).alias("properties"))
        entries, fields = entries.join(F.broadcast(named)), [*fields, "properties"]
    execution = F.struct(*fields, F.lit(start).alias("starttime"), F.lit(expiration).alias("expiration"))
    parts = [F.lit(1).alias("version"), execution.alias("execution")]
    if graph is not None:
        entries = entries.join(F.broadcast(graph.select(F.try_parse_json("graph").alias("scheduling"))))
        parts.append(F.col("scheduling"))
    return entries.select(F.to_json(F.struct(*parts)).alias("resources"))
