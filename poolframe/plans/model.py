"""The resource model over the star schema: pools in a containment forest, spans, jobs.

Pools: one cluster, a rack for each region, a node for each nation, a socket for each
supplier; customers hang from nodes in a second subsystem, `storage`. Spans are line items:
a socket's units from the ship date on for as many days as the quantity. Times are whole
days since 1995-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"
#: "Now" of the model: spans that hold then are allocations, later ones reservations.
NOW = 400
#: What the ids of each type begin at.
RACK, NODE, SOCKET, TENANT = 1, 100, 1_000, 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(stamp: Column) -> Column:
    return F.datediff(stamp, F.lit(EPOCH)).cast("bigint")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniq_id, type, name, id, rank, size, status, path and properties of every pool."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    none = F.create_map().cast("map<string,string>")

    def row(df: DataFrame, base: int, kind: str, key: Column, rank: Column, size: Column, status: Column, path: Column, properties: Column = none) -> DataFrame:
        key = key.cast("bigint")
        name = F.concat(F.lit(kind), key.cast("string"))
        return df.select(
            (key + base).alias("uniq_id"),
            F.lit(kind).alias("type"),
            name.alias("name"),
            key.alias("id"),
            rank.cast("bigint").alias("rank"),
            size.cast("bigint").alias("size"),
            status.alias("status"),
            F.concat(path, F.lit("/"), name).alias("path"),
            properties.alias("properties"),
        )

    up, none_rank = F.lit("up"), F.lit(-1)
    rack_path = F.concat(F.lit("/cluster0/rack"), F.col("n_regionkey").cast("string"))
    node_path = F.concat(rack_path, F.lit("/node"), F.col("n_nationkey").cast("string"))
    traits = F.map_from_arrays(F.array(F.col("n_name"), F.lit("perf_class")), F.array(F.lit(""), (F.col("n_nationkey") % 7).cast("string")))
    sockets = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    tenants = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        row(spark.range(1), 0, "cluster", F.lit(0), none_rank, F.lit(1), up, F.lit("")),
        row(table(spark, sf_dir, "region"), RACK, "rack", F.col("r_regionkey"), none_rank, F.lit(1), up, F.lit("/cluster0")),
        row(nation, NODE, "node", F.col("n_nationkey"), F.col("n_nationkey"), F.lit(1), F.when(F.col("n_nationkey") % 11 == 3, "down").otherwise("up"), rack_path, traits),
        row(sockets, SOCKET, "socket", F.col("s_suppkey"), F.col("n_nationkey"), 1 + F.col("s_suppkey") % 4, F.when(F.col("s_acctbal") < 0, "down").otherwise("up"), node_path),
        row(tenants, TENANT, "tenant", F.col("c_custkey"), none_rank, F.lit(1), up, node_path),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst and subsystem of every relation."""

    def row(df: DataFrame, src: Column, dst: Column, subsystem: str = "containment") -> DataFrame:
        return df.select(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(subsystem).alias("subsystem"))

    return (
        row(table(spark, sf_dir, "region"), F.lit(0), F.col("r_regionkey") + RACK)
        .unionByName(row(table(spark, sf_dir, "nation"), F.col("n_regionkey") + RACK, F.col("n_nationkey") + NODE))
        .unionByName(row(table(spark, sf_dir, "supplier"), F.col("s_nationkey") + NODE, F.col("s_suppkey") + SOCKET))
        .unionByName(row(table(spark, sf_dir, "customer"), F.col("c_nationkey") + NODE, F.col("c_custkey") + TENANT, "storage"))
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniq_id, jobid, st, last (the first day after) and planned units of every span."""
    start = day(F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") + SOCKET).alias("uniq_id"),
        F.col("l_orderkey").alias("jobid"),
        start.alias("st"),
        (start + F.col("l_quantity").cast("bigint")).alias("last"),
        F.col("l_linenumber").cast("bigint").alias("planned"),
    )


def wide_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three types of units at once, a row for each span with a column for each type."""
    start = day(F.col("l_shipdate"))
    units = {"core": F.col("l_linenumber"), "gpu": F.col("l_linenumber") % 2, "memory": F.col("l_quantity")}
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") + SOCKET).alias("uniq_id"),
        F.col("l_orderkey").alias("jobid"),
        start.alias("st"),
        (start + F.col("l_quantity").cast("bigint")).alias("last"),
        *[n.cast("bigint").alias(k) for k, n in units.items()],
    )


def multi_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three types of units at once, a row for each with rtype; requests of 0 count."""
    start = day(F.col("l_shipdate"))
    units = F.array(
        F.struct(F.lit("core").alias("rtype"), F.col("l_linenumber").cast("bigint").alias("planned")),
        F.struct(F.lit("gpu").alias("rtype"), (F.col("l_linenumber") % 2).cast("bigint").alias("planned")),
        F.struct(F.lit("memory").alias("rtype"), F.col("l_quantity").cast("bigint").alias("planned")),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select((F.col("l_suppkey") + SOCKET).alias("uniq_id"), F.col("l_orderkey").alias("jobid"), start.alias("st"), (start + F.col("l_quantity").cast("bigint")).alias("last"), F.inline(units))
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobid, queue, priority, t_submit, duration and nodes of every order as a job."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("jobid"),
            F.col("c_mktsegment").alias("queue"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"),
            day(F.col("o_orderdate")).alias("t_submit"),
            (1 + F.col("o_orderkey") % 30).alias("duration"),
            (1 + F.col("o_orderkey") % 8).alias("nodes"),
        )
    )
