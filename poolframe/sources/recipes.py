"""Recipes of pools in GraphML: kinds of pools, and how many of each there are below another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key: string, _VALUE: string>>"


def _rows(spark: SparkSession, path: str, tag: str, ids: str, defaults: dict[str, str]) -> DataFrame:
    """The elements of a tag with their attributes and a column for each key, its default where it isn't set."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(f"{ids}, {_DATA}").load(path)
    given = F.map_from_entries(F.transform("data", lambda x: F.struct(x["_key"], F.trim(x["_VALUE"]))))
    keys = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return rows.select(*[c for c in rows.columns if c != "data"], keys.alias("keys")).select("*", *[F.coalesce(F.col("keys")[k], F.lit(v)).alias(k) for k, v in defaults.items()]).drop("keys")


def recipe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The kinds of pools of a recipe, and its rules: a row for each edge, with the keys' defaults filled in."""
    kinds = _rows(spark, path, "node", "_id string", {"root": "0", "type": "", "basename": "", "unit": "", "size": "1", "subsystem": "containment"})
    rules = _rows(spark, path, "edge", "_id string, _source string, _target string", {"e_subsystem": "containment", "relation": "contains", "rrelation": "in", "id_scope": "0", "id_start": "0", "id_stride": "1", "gen_method": "MULTIPLY", "multi_scale": "1", "as_tgt_subsystem": "containment", "as_tgt_uplvl": "1", "as_src_uplvl": "1"})
    return kinds.withColumnRenamed("_id", "kind"), rules.withColumnRenamed("_source", "source").withColumnRenamed("_target", "target").drop("_id")


def scoped_id(above: Column, n: Column, number: int, start: int, stride: int, within: int) -> Column:
    """Id of the nth of `number` pools below the pool that has the ordinal `above` in its level.

    Ids count on over `within` pools in turn, those that have a common ancestor so many levels up, then start again; with
    0 they start again below each pool, and no stride is taken.
    """
    if within == 0:
        return (n + start).cast("bigint")
    return (((above % within) * number + n) * stride + start).cast("bigint")


def expand(spark: SparkSession, kinds: DataFrame, rules: DataFrame, subsystem: str = "containment") -> DataFrame:
    """type, name, id, size, path of the pools that the rules of one subsystem multiply, from its roots down.

    A recipe has as many rows as a configuration has lines; these are read by the driver, the pools are made by tasks.
    A kind without a type, or rules that run in a circle, are an error.
    """
    named = {r["kind"]: r for r in kinds.collect()}
    below: dict[str, list] = {}
    for rule in rules.where((F.col("e_subsystem") == subsystem) & (F.col("gen_method") == "MULTIPLY")).collect():
        below.setdefault(rule["source"], []).append(rule)
    out: DataFrame | None = None

    def placed(rows: DataFrame, kind: str, id: Column) -> DataFrame:
        row = named[kind]
        if not row["type"]:
            raise ValueError(f"a kind of pools has no type: {kind}")
        name = F.concat(F.lit(row["basename"] or row["type"]), id.cast("string"))
        return rows.select(F.lit(row["type"]).alias("type"), name.alias("name"), id.cast("bigint").alias("id"), F.lit(int(row["size"])).cast("bigint").alias("size"), F.concat("above", F.lit("/"), name).alias("path"), "ordinal")

    roots = [k for k, r in named.items() if r["subsystem"] == subsystem and r["root"] == "1"]
    first = spark.range(1).select(F.lit("").alias("above"), F.lit(0).cast("bigint").alias("ordinal"))
    todo = [(k, placed(first, k, F.lit(0)), [], (k,)) for k in roots]
    while todo:
        kind, level, scales, path = todo.pop()
        out = level if out is None else out.unionByName(level)
        for rule in below.get(kind, []):
            number, scope, target = int(rule["multi_scale"]), int(rule["id_scope"]), rule["target"]
            if target in path:
                raise ValueError(f"a recipe runs in a circle: {' > '.join((*path, target))}")
            within = 0
            if scope > 0:
                within = 1
                for scale in scales[-scope:]:
                    within *= scale
            rows = level.where(F.lit(number > 0)).select(F.col("path").alias("above"), F.col("ordinal").alias("before"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(number - 1, 0)).cast("bigint"))).alias("n"))
            rows = rows.select("above", (F.col("before") * number + F.col("n")).alias("ordinal"), scoped_id(F.col("before"), F.col("n"), number, int(rule["id_start"]), int(rule["id_stride"]), within).alias("id"))
            todo.append((target, placed(rows, target, F.col("id")), [*scales, number], (*path, target)))
    if out is None:
        raise ValueError(f"a recipe has no root in {subsystem}")
    return out.drop("ordinal")
