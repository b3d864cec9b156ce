"""Pools from recipes, graphs in JSON and lists of what ranks hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolframe.functions.counts import host_number
from poolframe.functions.idset import decode

GRAPH = (
    "graph struct<nodes: array<struct<id: string, metadata: struct<type: string, basename: string, name: string, id: bigint, uniq_id: bigint, rank: bigint, status: string, "
    "exclusive: boolean, unit: string, size: bigint, paths: map<string,string>, properties: map<string,string>>>>, edges: array<struct<source: string, target: string, metadata: struct<subsystem: string>>>>"
)
RESOURCES = "version int, execution struct<R_lite: array<struct<rank: string, children: map<string,string>>>, nodelist: array<string>, properties: map<string,string>, starttime: bigint, expiration: bigint>"


def multiply(above: DataFrame, kind: str, number: Column, first: int = 0, stride: int = 1) -> DataFrame:
    """type, id, path of `number` pools (a column) below each of `above` (path, ordinal), with ordinal for the next level.

    Ids count on over the whole level if all have the same number below them.
    """
    rows = above.select(F.col("ordinal").alias("before"), "path", number.cast("bigint").alias("many")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1)).alias("n"))
    ordinal = F.col("before") * F.col("many") + F.col("n")
    id = (first + ordinal * stride).cast("bigint")
    return rows.where("many > 0").select(F.lit(kind).alias("type"), id.alias("id"), ordinal.alias("ordinal"), F.concat("path", F.lit(f"/{kind}"), id.cast("string")).alias("path"))


def expand(spark: SparkSession, root: str, levels: Sequence[tuple[str, int, int, int]]) -> DataFrame:
    """type, id, path of the pools of a recipe: a root, and levels (type, number for each above, first id, stride).

    A level's pools are those above times its number, with ids that count on over the whole level.
    """
    level = spark.range(1).select(F.lit(root).alias("type"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(f"/{root}0").alias("path"))
    out = level
    for kind, number, first, stride in levels:
        level = level.select(F.lit(kind).alias("type"), F.col("ordinal").alias("above"), "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint"))).alias("n"))
        ordinal = F.col("above") * number + F.col("n")
        id = first + ordinal * stride
        level = level.select("type", id.cast("bigint").alias("id"), ordinal.alias("ordinal"), F.concat("path", F.lit(f"/{kind}"), id.cast("string")).alias("path"))
        out = out.unionByName(level)
    return out.select("type", "id", "path")


def graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of rows with a `graph` (of schema GRAPH); what metadata leaves out has its default."""
    meta = df.select(F.explode("graph.nodes").alias("x")).select(F.col("x.id").alias("node"), "x.metadata.*").where("type IS NOT NULL AND paths IS NOT NULL")
    basename = F.coalesce("basename", "type")
    number = F.coalesce("id", F.when(F.col("name").isNotNull(), host_number(F.col("name"))), F.lit(-1)).cast("bigint")
    vertices = meta.select(
        F.coalesce("uniq_id", F.col("node").cast("bigint")).alias("uniq_id"),
        "type",
        F.coalesce("name", F.concat(basename, F.when(number >= 0, number.cast("string")).otherwise(""))).alias("name"),
        number.alias("id"),
        F.coalesce("rank", F.lit(-1)).cast("bigint").alias("rank"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("size"),
        F.coalesce("status", F.lit("up")).alias("status"),
        F.coalesce("exclusive", F.lit(False)).alias("exclusive"),
        F.col("paths")["containment"].alias("path"),
        F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )
    edges = df.select(F.explode("graph.edges").alias("e")).select(F.col("e.source").cast("bigint").alias("src"), F.col("e.target").cast("bigint").alias("dst"), F.coalesce("e.metadata.subsystem", F.lit("containment")).alias("subsystem"))
    return vertices, edges


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of JSON lines, each with a part of a graph: files are read in splits."""
    return graph(spark.read.schema(GRAPH).json(path))


def rank_units(df: DataFrame) -> DataFrame:
    """rank, type, id of every unit in rows with `execution` (of schema RESOURCES)."""
    lite = df.select(F.explode("execution.R_lite").alias("r")).select(F.col("r.rank").alias("ranks"), F.explode("r.children").alias("type", "ids"))
    return decode(decode(lite, "ranks", "rank"), "ids", "id").select("rank", "type", "id")


def rank_hosts(df: DataFrame) -> DataFrame:
    """rank, host: hosts in turn are those of the ranks in ascending order.

    Ranks are numbered by stretches of 4096 and within these, so no task numbers all of them.
    """
    hosts = df.select(F.posexplode("execution.nodelist").alias("place", "host"))
    ranks = df.select(F.explode("execution.R_lite").alias("r")).select(F.col("r.rank").alias("ranks"))
    every = decode(ranks, "ranks", "rank").select("rank").distinct().withColumn("stretch", F.floor(F.col("rank") / 4096))
    before = every.groupBy("stretch").agg(F.count("*").alias("n")).select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"))
    placed = every.withColumn("n", F.row_number().over(Window.partitionBy("stretch").orderBy("rank"))).join(before, "stretch")
    return placed.select("rank", (F.col("before") + F.col("n") - 1).cast("int").alias("place")).join(hosts, "place").select("rank", "host")


def rank_properties(df: DataFrame) -> DataFrame:
    """rank, properties: the names set for each rank."""
    each = df.select(F.explode("execution.properties").alias("name", "ranks"))
    return decode(each, "ranks", "rank").groupBy("rank").agg(F.sort_array(F.collect_set("name")).alias("properties"))


def rank_property_values(df: DataFrame) -> DataFrame:
    """rank, properties: the same as a map; "name=value" sets a value, a name alone an empty one."""
    each = decode(df.select(F.explode("execution.properties").alias("given", "ranks")), "ranks", "rank").select("rank", "given").distinct()
    named = each.select("rank", F.substring_index("given", "=", 1).alias("name"), F.expr("substring(given, length(substring_index(given, '=', 1)) + 2)").alias("value"))
    one = named.groupBy("rank", "name").agg(F.max("value").alias("value"))
    return one.groupBy("rank").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("properties"))


def rank_graph(df: DataFrame, root: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """Vertices (type, name, id, rank, size, status, path, properties) and edges (above, path) of rows with `execution`.

    A root, below it a node for each rank, named as its host, and below a node its rank's units.
    """
    none = F.create_map().cast("map<string,string>")
    top = f"/{root}0"

    def row(rows: DataFrame, kind: Column, name: Column, id: Column, rank: Column, path: Column, properties: Column = none) -> DataFrame:
        columns = {"type": kind, "name": name, "id": id.cast("bigint"), "rank": rank.cast("bigint"), "size": F.lit(1).cast("bigint"), "status": F.lit("up"), "path": path, "properties": properties}
        return rows.select(*[c.alias(n) for n, c in columns.items()])

    hosts = rank_hosts(df).withColumn("above", F.concat(F.lit(f"{top}/"), "host"))
    nodes = hosts.join(rank_property_values(df), "rank", "left")
    units = rank_units(df).join(hosts, "rank").withColumn("unit", F.concat("type", F.col("id").cast("string")))
    first = row(df.sparkSession.range(1), F.lit(root), F.lit(f"{root}0"), F.lit(0), F.lit(-1), F.lit(top))
    vertices = first.unionByName(row(nodes, F.lit("node"), F.col("host"), host_number(F.col("host")), F.col("rank"), F.col("above"), F.coalesce("properties", none)))
    vertices = vertices.unionByName(row(units, F.col("type"), F.col("unit"), F.col("id"), F.col("rank"), F.concat("above", F.lit("/"), "unit")))
    edges = hosts.select(F.lit(top).alias("above"), F.col("above").alias("path")).unionByName(units.select("above", F.concat("above", F.lit("/"), "unit").alias("path")))
    return vertices, edges


def graph_rows(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of `rank_graph` with uniq_id, and edges by these, as graphs are written.

    A rank's pools have numbers of their own, 2^20 a rank at most, so none is numbered over all ranks.
    """
    turn = Window.partitionBy("rank").orderBy(F.length("path"), "path")
    n = F.row_number().over(turn) - 1
    whole = F.when(n < 1 << 20, n).otherwise(F.raise_error(F.concat(F.lit("a rank has more than 2^20 pools: "), F.col("rank").cast("string"))).cast("int"))
    numbered = vertices.withColumn("uniq_id", ((F.col("rank") + 1) * (1 << 20) + whole).cast("bigint"))
    ids = numbered.select("path", F.col("uniq_id").alias("dst"))
    up = ids.select(F.col("path").alias("above"), F.col("dst").alias("src"))
    return numbered, edges.join(ids, "path").join(up, "above").select("src", "dst", F.lit("containment").alias("subsystem"))


def same_units(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, same: whether two tables of units (by, rank, type, id) hold the same for each key, however they are listed."""
    both = a.select(*by, "rank", "type", "id", F.lit(1).alias("side")).unionByName(b.select(*by, "rank", "type", "id", F.lit(2).alias("side")))
    each = both.groupBy(*by, "rank", "type", "id").agg(F.bit_or("side").alias("sides"))
    return each.groupBy(*by).agg(F.bool_and(F.col("sides") == 3).alias("same"))


def allowed(vertices: DataFrame, types: str) -> DataFrame:
    """Vertices of the types in a comma list; an empty list allows all."""
    chosen = [t.strip() for t in types.split(",") if t.strip()]
    return vertices.where(F.col("type").isin(*chosen)) if chosen else vertices


def remap(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Units (rank, type, id) with ids of their own space, by ranges (low, high, type, ref, new); others keep theirs.

    Ranges are a table of settings; the join is on type and id, the range only filters.
    """
    wanted = ranges.select(F.col("type").alias("of_type"), F.col("ref").alias("id"), "low", "high", "new")
    match = (units.type == wanted.of_type) & (units.id == wanted.id) & units["rank"].between(wanted.low, wanted.high)
    return units.join(wanted, match, "left").select(units["rank"], units.type, F.coalesce("new", units.id).alias("id"))


def shorthand(vertices: DataFrame, pairs: DataFrame, given: DataFrame) -> DataFrame:
    """The vertices that `given` (uniq_id, exclusive) stands for: an exclusive one brings all below it."""
    chosen = pairs.join(given.withColumnRenamed("uniq_id", "anc"), "anc").where("depth = 0 OR exclusive").select(F.col("desc").alias("uniq_id")).distinct()
    return vertices.join(chosen, "uniq_id", "left_semi")


#: Ids of one path are listed by ranges of so many, and pairs are made of so many targets at a time.
IDS, TURN = 1 << 16, 128


def associate(sources: DataFrame, targets: DataFrame, levels: Column) -> DataFrame:
    """src, dst of pools whose paths are equal without their last names, `levels` of them.

    Every source of a path meets every target: there are as many rows as pairs. Lists of ids are joined and dealt, and
    pairs are made where they are read. They come in short turns, which files hold well.
    """

    def lists(pools: DataFrame, name: str) -> DataFrame:
        return pools.groupBy(levels.alias("above"), F.floor(F.col("uniq_id") / IDS)).agg(F.collect_list("uniq_id").alias(name)).select("above", name)

    met = lists(sources, "srcs").join(lists(targets, "dsts"), "above").select("srcs", "dsts")
    # A path with very many pools is dealt to all tasks.
    dealt = met.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    turns = F.transform(F.sequence(F.lit(1), F.size("dsts"), F.lit(TURN)), lambda n: F.slice("dsts", n, TURN))
    turned = dealt.select("srcs", F.explode(turns).alias("dsts"))
    return turned.select("dsts", F.explode("srcs").alias("src")).select("src", F.explode("dsts").alias("dst"))
