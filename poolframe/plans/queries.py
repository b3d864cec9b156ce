"""The library's own queries over the star schema, and their twins in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolframe.functions import counts, idset
from poolframe.operators import closure, find, jobs, match, policy, predicates, rollup, timeline, update
from poolframe.plans import model
from poolframe.sources import readers, requests, writers
from poolframe.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tables of the model in SQL; each query takes those that it names.
_V = """
v AS (SELECT 0::BIGINT AS uniq_id, 'cluster' AS type, 'cluster0' AS name, 0::BIGINT AS id, -1::BIGINT AS rank, 1::BIGINT AS size, 'up' AS status, '/cluster0' AS path, '' AS n_name
 UNION ALL SELECT 1 + r_regionkey, 'rack', 'rack' || r_regionkey, r_regionkey, -1, 1, 'up', '/cluster0/rack' || r_regionkey, '' FROM region
 UNION ALL SELECT 100 + n_nationkey, 'node', 'node' || n_nationkey, n_nationkey, n_nationkey, 1, CASE WHEN n_nationkey % 11 = 3 THEN 'down' ELSE 'up' END, '/cluster0/rack' || n_regionkey || '/node' || n_nationkey, n_name FROM nation
 UNION ALL SELECT 1000 + s_suppkey, 'socket', 'socket' || s_suppkey, s_suppkey, s_nationkey, 1 + s_suppkey % 4, CASE WHEN s_acctbal < 0 THEN 'down' ELSE 'up' END, '/cluster0/rack' || n_regionkey || '/node' || n_nationkey || '/socket' || s_suppkey, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 10000000 + c_custkey, 'tenant', 'tenant' || c_custkey, c_custkey, -1, 1, 'up', '/cluster0/rack' || n_regionkey || '/node' || n_nationkey || '/tenant' || c_custkey, '' FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_E = """
ed AS (SELECT 0::BIGINT AS src, (1 + r_regionkey)::BIGINT AS dst, 'containment' AS subsystem FROM region
 UNION ALL SELECT 1 + n_regionkey, 100 + n_nationkey, 'containment' FROM nation
 UNION ALL SELECT 100 + s_nationkey, 1000 + s_suppkey, 'containment' FROM supplier
 UNION ALL SELECT 100 + c_nationkey, 10000000 + c_custkey, 'storage' FROM customer)"""
_C = """
cl AS (SELECT dst AS a, dst AS b, 0 AS depth FROM ed WHERE subsystem = 'containment' UNION ALL SELECT 0, 0, 0
 UNION ALL SELECT up.src, cl.b, cl.depth + 1 FROM cl JOIN ed up ON up.dst = cl.a AND up.subsystem = 'containment')"""
_S = """
sp AS (SELECT (1000 + l_suppkey)::BIGINT AS v, l_orderkey AS jobid, datediff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS st,
 datediff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT + l_quantity::BIGINT AS last, l_linenumber::BIGINT AS n FROM lineitem)"""


def _points(name: str, spans: str, by: str = "v") -> str:
    """SQL of a timeline with totals of peaks, from a table of spans."""
    return f"""
{name}_ev AS (SELECT {by}, st AS tm, n AS d FROM {spans} UNION ALL SELECT {by}, last, -n FROM {spans} UNION ALL SELECT DISTINCT {by}, 0, 0 FROM {spans}),
{name}_run AS (SELECT {by}, tm, sum(sum(d)) OVER (PARTITION BY {by} ORDER BY tm)::BIGINT AS used FROM {name}_ev GROUP BY {by}, tm),
{name} AS (SELECT {by}, tm, max(used) OVER (PARTITION BY {by}) - used AS remaining, max(used) OVER (PARTITION BY {by}) AS total FROM {name}_run)"""


_T = _points("tl", "sp")


def query(sql: str = "", *tables: str) -> Callable:
    """Registers a query by its name, with its SQL after the tables that this needs."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = ("WITH RECURSIVE " + ",".join(tables) + "\n" if tables else "") + sql
        return run

    return register


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.peak_timeline(model.spans(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.closure(model.edges(spark, sf_dir).where("subsystem = 'containment'"), levels=3)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.vertices(spark, sf_dir).where("type != 'tenant'")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.states(_held(spark, sf_dir), model.spans(spark, sf_dir), _pairs(spark, sf_dir), model.NOW)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("poolframe.shared.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="poolframe-")
        spark.conf.set("poolframe.shared.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a shared folder and read again."""
    path = _scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Capacity over time.


@query("SELECT v AS uniq_id, tm, remaining, total FROM tl", _S, _T)
def planner_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query("SELECT v AS uniq_id, min(tm) AS tm FROM (SELECT v, tm, total, min(remaining) OVER (PARTITION BY v ORDER BY tm RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) AS m FROM tl) WHERE tm >= 400 AND 2 * m >= total GROUP BY v", _S, _T)
def planner_avail_time_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.first_fit(_timeline(spark, sf_dir), 7, F.ceil(F.col("total") / 2), after=400)


@query("SELECT v AS uniq_id, place, tm FROM (SELECT v, tm, row_number() OVER (PARTITION BY v ORDER BY tm)::INT AS place FROM (SELECT *, min(remaining) OVER (PARTITION BY v ORDER BY tm RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM tl) WHERE tm >= 100 AND m >= 5) WHERE place <= 3", _S, _T)
def planner_avail_time_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.next_fits(_timeline(spark, sf_dir), 3, F.lit(5), 3, after=100)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each pool of each job, as often as the job has a span there: when the job is submitted."""
    orders = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jobid"), model.day(F.col("o_orderdate")).alias("tm"))
    return model.spans(spark, sf_dir).select("uniq_id", "jobid").join(orders, "jobid").select("uniq_id", "tm", "jobid")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline, written, as questions read it several times."""
    return _kept(_timeline(spark, sf_dir), "points")


_A = """
ask AS (SELECT (1000 + l_suppkey)::BIGINT AS v, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS tm, o_orderkey AS jobid, row_number() OVER () AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("SELECT ask.v AS uniq_id, ask.tm, ask.jobid, tl.remaining FROM ask ASOF LEFT JOIN tl ON ask.v = tl.v AND ask.tm >= tl.tm", _S, _T, _A)
def planner_avail_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.at(_written(spark, sf_dir), _asked(spark, sf_dir))


_SEG = "seg AS (SELECT *, lead(tm) OVER (PARTITION BY v ORDER BY tm) AS until FROM tl)"
_DURING = "during AS (SELECT ask.v, ask.tm, ask.jobid, ask.q, min(remaining) AS least FROM ask LEFT JOIN seg ON seg.v = ask.v AND seg.tm < ask.tm + 10 AND (seg.until IS NULL OR seg.until > ask.tm) GROUP BY ALL)"


def _least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.during(_timeline(spark, sf_dir), _asked(spark, sf_dir).withColumn("duration", F.lit(10).cast("bigint")), longest=10)


@query("SELECT v AS uniq_id, tm, jobid, 10::BIGINT AS duration, least FROM during", _S, _T, _A, _SEG, _DURING)
def planner_min_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _least(spark, sf_dir).select("uniq_id", "tm", "jobid", "duration", "least")


@query("SELECT v AS uniq_id, count(*) AS asked, count(*) FILTER (least >= 4) AS met FROM during GROUP BY v", _S, _T, _A, _SEG, _DURING)
def planner_avail_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _least(spark, sf_dir).groupBy("uniq_id").agg(F.count("*").alias("asked"), F.count_if(F.col("least") >= 4).alias("met"))


#: One new span a job, and whether it fits beside those before it: a pool's spans are tried one by one.
_NEW = """
one AS (SELECT (1000 + min(l_suppkey))::BIGINT AS v, o_orderkey AS jobid, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
nw AS MATERIALIZED (SELECT *, st + 10 AS last, 12::BIGINT AS n, row_number() OVER (PARTITION BY v ORDER BY st, jobid) AS k FROM one),
lv AS MATERIALIZED (SELECT nw.v, nw.k, list(struct_pack(a := greatest(seg.tm, nw.st), r := seg.remaining) ORDER BY seg.tm) AS lv FROM nw JOIN seg ON seg.v = nw.v AND seg.tm < nw.last AND (seg.until IS NULL OR seg.until > nw.st) GROUP BY nw.v, nw.k),
tr AS (SELECT DISTINCT v, 0::BIGINT AS k, []::STRUCT(st BIGINT, last BIGINT, n BIGINT)[] AS acc, 0::BIGINT AS added FROM nw
 UNION ALL SELECT v, k, CASE WHEN ok THEN list_append(near, struct_pack(st := st, last := last, n := n)) ELSE near END, added + CASE WHEN ok THEN 1 ELSE 0 END
 FROM (SELECT *, list_min(list_transform(list_concat(list_transform(lv, lambda x: x.a), list_transform(near, lambda y: greatest(y.st, st))),
   lambda t: list_filter(lv, lambda x: x.a <= t)[-1].r - coalesce(list_sum(list_transform(list_filter(near, lambda y: y.st <= t AND y.last > t), lambda y: y.n)), 0))) >= n AS ok
  FROM (SELECT nw.v, nw.k, nw.st, nw.last, nw.n, lv.lv, tr.added, list_filter(tr.acc, lambda y: y.last > nw.st) AS near FROM tr JOIN nw ON nw.v = tr.v AND nw.k = tr.k + 1 JOIN lv ON lv.v = nw.v AND lv.k = nw.k))),
ad AS (SELECT v, max(added) AS added FROM tr GROUP BY v)"""


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of ten days on the first pool of each job, numbered in order of days."""
    first = model.spans(spark, sf_dir).groupBy("jobid").agg(F.min("uniq_id").alias("uniq_id"))
    orders = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jobid"), model.day(F.col("o_orderdate")).alias("st"))
    return first.join(orders, "jobid").select("uniq_id", ((F.col("st") + 100_000) * 10_000_000_000 + F.col("jobid")).alias("jobid"), "st", (F.col("st") + 10).alias("last"), F.lit(12).cast("bigint").alias("planned"))


@query("SELECT sp.v AS uniq_id, count(*) + coalesce(max(ad.added), 0) AS spans, (sum(n) + coalesce(max(ad.added), 0) * 12)::BIGINT AS units FROM sp LEFT JOIN ad ON ad.v = sp.v GROUP BY sp.v", _S, _T, _SEG, _NEW)
def planner_add_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = timeline.add_spans(model.spans(spark, sf_dir), _written(spark, sf_dir), _new(spark, sf_dir), longest=10)
    return added.groupBy("uniq_id").agg(F.count("*").alias("spans"), F.sum("planned").alias("units"))


@query("SELECT v AS uniq_id, tm, sum(sum(d)) OVER (PARTITION BY v ORDER BY tm)::BIGINT AS used FROM (SELECT v, st AS tm, n AS d FROM sp WHERE jobid % 5 <> 0 UNION ALL SELECT v, last, -n FROM sp WHERE jobid % 5 <> 0) GROUP BY v, tm", _S)
def planner_rem_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = model.table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("jobid"))
    return timeline.usage(timeline.remove_spans(model.spans(spark, sf_dir), gone))


@query("SELECT v AS uniq_id, jobid, st, last, CASE WHEN jobid % 4 > n THEN n ELSE n - jobid % 4 END AS planned FROM sp WHERE CASE WHEN jobid % 4 > n THEN n ELSE n - jobid % 4 END > 0", _S)
def planner_reduce_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    less = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jobid"), (F.col("o_orderkey") % 4).alias("units"))
    return timeline.reduce_spans(model.spans(spark, sf_dir), less)


@query("SELECT v AS uniq_id, tm, greatest(remaining - 20, 0) AS remaining, greatest(total - 20, 0) AS total FROM tl", _S, _T)
def planner_update_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.change_totals(_timeline(spark, sf_dir), F.lit(-20))


@query("SELECT v AS uniq_id, count(*) AS spans, min(st) AS first_start, max(last) AS last_end, max(last - st) AS longest, count(*) FILTER (st <= 400 AND last > 400) AS active FROM sp GROUP BY v", _S)
def planner_span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = (F.col("st") <= model.NOW) & (F.col("last") > model.NOW)
    return model.spans(spark, sf_dir).groupBy("uniq_id").agg(F.count("*").alias("spans"), F.min("st").alias("first_start"), F.max("last").alias("last_end"), F.max(F.col("last") - F.col("st")).alias("longest"), F.count_if(active).alias("active"))


_M = """
ms AS (SELECT v, jobid, st, last, 'core' AS rtype, n FROM sp UNION ALL SELECT v, jobid, st, last, 'gpu', n % 2 FROM sp UNION ALL SELECT v, jobid, st, last, 'memory', last - st FROM sp)"""
_MT = _points("ml", "ms", "v, rtype")


#: What a span over several types asks for.
_WANTED = {"core": 8, "gpu": 1, "memory": 60}


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.peak_timelines(model.wide_spans(spark, sf_dir), list(_WANTED))


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("rtype"), F.col(k).alias("remaining")) for k in _WANTED])
    return _wide(spark, sf_dir).select("uniq_id", "tm", F.inline(kinds))


@query("SELECT v AS uniq_id, min(tm) AS tm FROM (SELECT v, tm, bool_and(m >= CASE rtype WHEN 'core' THEN 8 WHEN 'gpu' THEN 1 ELSE 60 END) AS ok FROM (SELECT *, min(remaining) OVER (PARTITION BY v, rtype ORDER BY tm RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM ml) WHERE tm >= 300 GROUP BY v, tm HAVING count(*) = 3) WHERE ok GROUP BY v", _S, _M, _MT)
def planner_multi_avail_time_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fits_at_once(_wide(spark, sf_dir), 5, _WANTED, after=300).groupBy("uniq_id").agg(F.min("tm").alias("tm"))


@query("SELECT v AS uniq_id, max(remaining) FILTER (rtype = 'core') AS core, max(remaining) FILTER (rtype = 'gpu') AS gpu, max(remaining) FILTER (rtype = 'memory') AS memory FROM (SELECT v, rtype, arg_max(remaining, tm) AS remaining FROM ml WHERE tm <= 500 GROUP BY v, rtype) GROUP BY v", _S, _M, _MT)
def planner_multi_avail_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _multi(spark, sf_dir).where("tm <= 500").groupBy("uniq_id", "rtype").agg(F.max_by("remaining", "tm").alias("remaining"))
    return latest.groupBy("uniq_id").pivot("rtype", ["core", "gpu", "memory"]).agg(F.max("remaining"))


@query("SELECT v AS uniq_id, rtype, sum(n)::BIGINT AS planned, count(*) FILTER (n > 0) AS spans FROM ms WHERE jobid % 3 <> 0 GROUP BY v, rtype", _S, _M)
def planner_multi_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = model.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("jobid"))
    kept = timeline.remove_spans(model.multi_spans(spark, sf_dir), gone)
    return kept.groupBy("uniq_id", "rtype").agg(F.sum("planned").alias("planned"), F.count_if(F.col("planned") > 0).alias("spans"))


@query("SELECT v AS uniq_id, jobid, rtype, st, last, n - jobid % 3 AS planned FROM ms WHERE rtype = 'core' AND n > jobid % 3 UNION ALL SELECT v, jobid, rtype, st, last, n FROM ms WHERE rtype = 'core' AND n < jobid % 3 UNION ALL SELECT v, jobid, rtype, st, last, n FROM ms WHERE rtype <> 'core' AND n > 0", _S, _M)
def planner_multi_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    less = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jobid"), F.lit("core").alias("rtype"), (F.col("o_orderkey") % 3).alias("units"))
    return timeline.reduce_spans(model.multi_spans(spark, sf_dir), less, ("jobid", "rtype")).select("uniq_id", "jobid", "rtype", "st", "last", "planned")


@query("SELECT v AS uniq_id, bool_and(least >= CASE rtype WHEN 'core' THEN 8 WHEN 'gpu' THEN 1 ELSE 60 END) AS met FROM (SELECT v, rtype, min(remaining) AS least FROM (SELECT *, lead(tm) OVER (PARTITION BY v, rtype ORDER BY tm) AS until FROM ml) WHERE tm < 330 AND (until IS NULL OR until > 300) GROUP BY v, rtype) GROUP BY v", _S, _M, _MT)
def planner_multi_avail_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pool has enough of every type over a month."""
    met = [timeline.least_over(300, 30, k) >= n for k, n in _WANTED.items()]
    return _wide(spark, sf_dir).groupBy("uniq_id").agg((met[0] & met[1] & met[2]).alias("met"))


@query("SELECT v AS uniq_id, rtype, tm, CASE rtype WHEN 'core' THEN 100 ELSE 900 END - used AS remaining, CASE rtype WHEN 'core' THEN 100 ELSE 900 END::BIGINT AS total FROM ml_run WHERE rtype <> 'gpu' UNION ALL SELECT DISTINCT v, 'disk', 0, 7, 7 FROM sp", _S, _M, _MT)
def planner_multi_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines after totals were changed, a type was taken away and one came new."""
    spans = model.multi_spans(spark, sf_dir)
    totals = spans.select("uniq_id").distinct().select("uniq_id", F.inline(F.array(*[F.struct(F.lit(t).alias("rtype"), F.lit(n).cast("bigint").alias("total")) for t, n in (("core", 100), ("memory", 900), ("disk", 7))])))
    return timeline.timeline(spans, totals, ("uniq_id", "rtype"))


# The hierarchy.


@query("SELECT a AS anc, b AS desc_, depth FROM cl", _E, _C)
def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumnRenamed("desc", "desc_")


@query("SELECT v.type, count(*) AS pools, count(DISTINCT v.name) AS names, count(DISTINCT v.path) AS paths, sum(v.size)::BIGINT AS units FROM v GROUP BY v.type", _V)
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.vertices(spark, sf_dir).groupBy("type").agg(F.count("*").alias("pools"), F.countDistinct("name").alias("names"), F.countDistinct("path").alias("paths"), F.sum("size").alias("units"))


@query("SELECT v.uniq_id, v.path FROM v JOIN cl ON cl.b = v.uniq_id WHERE cl.a IN (SELECT uniq_id FROM v WHERE name = 'rack2')", _V, _E, _C)
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _held(spark, sf_dir).where("name = 'rack2'").select("uniq_id")
    return _held(spark, sf_dir).join(closure.descendants(_pairs(spark, sf_dir), root), "uniq_id", "left_semi").select("uniq_id", "path")


@query("SELECT dst AS uniq_id, src AS parent, subsystem FROM ed", _E)
def parent_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = model.edges(spark, sf_dir)
    return edges.select(F.col("dst").alias("uniq_id"), F.col("src").alias("parent"), "subsystem")


@query("SELECT cl.a AS anchor, v.type AS rtype, sum(v.size)::BIGINT AS total FROM cl JOIN v ON v.uniq_id = cl.b JOIN v w ON w.uniq_id = cl.a WHERE depth > 0 AND (v.type = 'socket' OR v.type = 'node' AND w.type = 'cluster') GROUP BY ALL", _V, _E, _C)
def prune_filter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.subtree_totals(_held(spark, sf_dir), _pairs(spark, sf_dir), {"ALL": ["socket"], "cluster": ["node"]})


@query("SELECT cl.a AS anchor, 'socket' AS rtype, sum(n)::BIGINT AS used FROM sp JOIN cl ON cl.b = sp.v WHERE st <= 400 AND last > 400 AND depth > 0 GROUP BY ALL", _S, _E, _C)
def agfilter_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.subtree_usage(model.spans(spark, sf_dir), _held(spark, sf_dir), _pairs(spark, sf_dir), model.NOW)


def _ranges(table: str, by: str, id: str, out: str) -> str:
    """SQL of compressed sets: ids less their place in order are equal within a range."""
    return f"(SELECT {by}, string_agg(CASE WHEN low = high THEN low::VARCHAR ELSE low || '-' || high END, ',' ORDER BY low) AS {out} FROM (SELECT {by}, min({id}) AS low, max({id}) AS high FROM (SELECT *, {id} - row_number() OVER (PARTITION BY {by} ORDER BY {id}) AS island FROM (SELECT DISTINCT {by}, {id} FROM {table})) GROUP BY {by}, island) GROUP BY {by})"


@query("SELECT size, ranks FROM " + _ranges("h", "size", "rank", "ranks"), _V, _E, _C, "h AS (SELECT v.rank, count(*) AS size FROM v JOIN cl ON cl.a = v.uniq_id WHERE v.type = 'node' GROUP BY v.rank)")
def rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rank_histogram(_held(spark, sf_dir), _pairs(spark, sf_dir))


@query("SELECT count(*) FILTER (status = 'up') AS up, count(*) AS nodes FROM v WHERE type = 'node'", _V)
def node_up_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).where("type = 'node'").agg(F.count_if(F.col("status") == "up").alias("up"), F.count("*").alias("nodes"))


@query("SELECT count(*) AS njobs, min(w) AS least, max(w) AS most, arg_min(jobid, (-w, jobid)) AS most_job, round(avg(w), 6) AS average, round(var_pop(w), 6) AS variance FROM (SELECT jobid, max(last - st) AS w FROM sp GROUP BY jobid)", _S)
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = model.spans(spark, sf_dir).groupBy("jobid").agg(F.max(F.col("last") - F.col("st")).alias("w"))
    return rollup.match_statistics(times, "w", "jobid").withColumns({"average": F.round("average", 6), "variance": F.round("variance", 6)})


_R = "rq AS (SELECT o_orderkey AS jobid, 1 + o_orderkey % 3 AS nodes, 1 + o_orderkey % 2 AS sockets FROM orders)"


@query("SELECT jobid, 'node' AS type, nodes AS total FROM rq UNION ALL SELECT jobid, 'socket', nodes * sockets FROM rq UNION ALL SELECT jobid, 'core', nodes * sockets * 4 FROM rq", _R)
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = F.array(
        F.struct(F.lit(1).alias("req"), F.lit(None).cast("int").alias("parent"), F.lit("node").alias("type"), (1 + key % 3).alias("cmin")),
        F.struct(F.lit(2).alias("req"), F.lit(1).alias("parent"), F.lit("socket").alias("type"), (1 + key % 2).alias("cmin")),
        F.struct(F.lit(3).alias("req"), F.lit(2).alias("parent"), F.lit("core").alias("type"), F.lit(4).cast("bigint").alias("cmin")),
    )
    return rollup.request_totals(model.table(spark, sf_dir, "orders").select(key.alias("jobid"), F.inline(rows)), levels=2)


@query("SELECT cl.a AS anchor FROM cl JOIN v ON v.uniq_id = cl.b WHERE depth > 0 GROUP BY cl.a HAVING sum(v.size) FILTER (v.type = 'socket') >= 30 AND sum(v.size) FILTER (v.type = 'node') >= 3", _V, _E, _C)
def subplan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollup.subtree_totals(_held(spark, sf_dir), _pairs(spark, sf_dir), rollup.tracked_types("ALL:socket,ALL:node"))
    return rollup.anchors_with(totals, {"socket": 30, "node": 3})


@query("SELECT jobid, least(t_submit + CASE WHEN duration = 1 THEN 2000 ELSE duration END, 2000) AS until, CASE WHEN t_submit >= 2000 THEN 'busy' ELSE 'ok' END AS state FROM jb", "jb AS (SELECT o_orderkey AS jobid, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t_submit, (1 + o_orderkey % 30)::BIGINT AS duration FROM orders)")
def job_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = model.jobs(spark, sf_dir).select("jobid", F.col("t_submit").alias("at"), F.when(F.col("duration") == 1, 0.0).otherwise(F.col("duration") - 0.5).alias("duration"))
    return jobs.windows(timed, 0, 2000).select("jobid", "until", "state")


# Searching.

_ST = """
fl AS (SELECT uniq_id, status = 'down' AS d, uniq_id IN (SELECT v FROM sp WHERE st <= 400 AND last > 400) AS a, uniq_id IN (SELECT v FROM sp WHERE st > 400) AS r FROM v WHERE type <> 'tenant'),
st AS (SELECT cl.b AS uniq_id, bool_or(fl.d) AS down, bool_or(fl.a) AS allocated, bool_or(fl.r) AS reserved FROM cl JOIN fl ON fl.uniq_id = cl.a GROUP BY cl.b)"""


def _find_sql(condition: str) -> str:
    return f"SELECT v.uniq_id, v.name, bool_or(h.b IS NOT NULL AND h.b = v.uniq_id) AS hit FROM v JOIN (SELECT cl.a, cl.b FROM cl WHERE cl.b IN (SELECT st.uniq_id FROM st JOIN v ON v.uniq_id = st.uniq_id WHERE {condition})) h ON h.a = v.uniq_id GROUP BY v.uniq_id, v.name"


def _found(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    # What a search reads more than once is written first, as a session of searches would keep it.
    pairs = _kept(_pairs(spark, sf_dir), "pairs")
    stated = _kept(find.states(_held(spark, sf_dir), model.spans(spark, sf_dir), pairs, model.NOW, predicates.jobs_of(text)), "states")
    return find.find(stated, pairs, predicates.criteria(text)).select("uniq_id", "name", "hit")


@query(_find_sql("down"), _V, _E, _C, _S, _ST)
def find_status_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "status=down")


@query(_find_sql("NOT down AND allocated OR reserved AND v.name IN ('node3', 'node4', 'node5')"), _V, _E, _C, _S, _ST)
def find_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "status=up sched-now=allocated or (sched-future=reserved and names=node[3-5])")


@query(_find_sql("v.uniq_id IN (SELECT v FROM sp WHERE jobid IN (7, 8) AND (st > 400 OR last > 400))"), _V, _E, _C, _S, _ST)
def find_jobid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "jobid-span=7 or jobid-span=8")


@query(_find_sql("v.uniq_id IN (SELECT cl.a FROM cl JOIN sp ON sp.v = cl.b WHERE jobid = 7) AND NOT down"), _V, _E, _C, _S, _ST)
def find_jobid_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools on or above a job's spans, that are up."""
    return _found(spark, sf_dir, "jobid-tag=7 status=up")


@query(_find_sql("v.type = 'node' AND v.uniq_id <> 0"), _V, _E, _C, _S, _ST)
def find_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "property=perf_class")


@query("SELECT v.type, count(*) AS all_n, count(*) FILTER (down) AS down_n, count(*) FILTER (allocated) AS allocated_n FROM st JOIN v ON v.uniq_id = st.uniq_id GROUP BY v.type", _V, _E, _C, _S, _ST)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.status_counts(_states(spark, sf_dir))


@query("SELECT uniq_id, type FROM v WHERE type <> 'tenant' AND uniq_id NOT IN (SELECT cl.a FROM cl JOIN sp ON sp.v = cl.b WHERE st < 10 AND last > 3)", _V, _E, _C, _S)
def excl_overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.free_of(_held(spark, sf_dir), model.spans(spark, sf_dir), _pairs(spark, sf_dir), 3, 10).select("uniq_id", "type")


@query("SELECT uniq_id, type FROM v WHERE type <> 'tenant' AND uniq_id NOT IN (SELECT cl.b FROM cl JOIN v w ON w.uniq_id = cl.a WHERE w.status = 'down')", _V, _E, _C)
def usable_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.usable(_held(spark, sf_dir), _pairs(spark, sf_dir), F.col("status") == "up").select("uniq_id", "type")


_CONSTRAINT = {"or": [{"and": [{"properties": ["perf_class"]}, {"ranks": ["2-9"]}]}, {"not": [{"hostlist": ["node[0-19]"]}, {"properties": ["^none"]}]}]}


@query("SELECT uniq_id, name, rank BETWEEN 2 AND 9 OR id > 19 AS kept FROM v WHERE type = 'node'", _V)
def constraint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).where("type = 'node'").select("uniq_id", "name", predicates.node_constraint(_CONSTRAINT).alias("kept"))


# Choosing.


def _free(spark: SparkSession, sf_dir: str, *more: Column, st: int = 400, duration: int = 30) -> DataFrame:
    """Sockets with what remains of their peaks over a window, and more aggregates of their points."""
    least = _timeline(spark, sf_dir).groupBy("uniq_id").agg(timeline.least_over(st, duration).alias("free"), *more)
    return _held(spark, sf_dir).join(least, "uniq_id", "left").withColumn("free", F.coalesce("free", "size"))


_F = """
fr AS (SELECT v.*, up.src AS parent, CASE WHEN v.type = 'socket' THEN coalesce(w.least, v.size) ELSE v.size END AS free FROM v LEFT JOIN ed up ON up.dst = v.uniq_id
 LEFT JOIN (SELECT v, min(remaining) AS least FROM seg WHERE tm < 430 AND (until IS NULL OR until > 400) GROUP BY v) w ON w.v = v.uniq_id WHERE v.type <> 'tenant')"""


def _best_sql(order: str, need: str = "25", by: str = "parent", table: str = "fr WHERE type = 'socket' AND free > 0", extra: str = "") -> str:
    return f"SELECT uniq_id, parent, least(free, {need} - (upto - free)) AS taken{extra} FROM (SELECT *, sum(free) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(free) OVER (PARTITION BY {by})::BIGINT AS of_all FROM {table}) WHERE of_all >= {need} AND upto - free < {need}"


def _sockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = closure.parents(model.edges(spark, sf_dir))
    return _free(spark, sf_dir).where("type = 'socket' AND free > 0").join(up, "uniq_id")


@query(_best_sql("id DESC"), _V, _E, _S, _T, _SEG, _F)
def match_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.best(_sockets(spark, sf_dir), F.lit(25).cast("bigint"), ["parent"], [policy.id_score(F.col("id")).desc(), F.col("uniq_id")], "free").select("uniq_id", "parent", "taken")


@query(_best_sql("id"), _V, _E, _S, _T, _SEG, _F)
def match_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.best(_sockets(spark, sf_dir), F.lit(25).cast("bigint"), ["parent"], [policy.id_score(F.col("id")).asc(), F.col("uniq_id")], "free").select("uniq_id", "parent", "taken")


@query(_best_sql("(rank + 2) * 10000 + abs((rank + 100) % 10000 - 1) + id DESC, uniq_id", "100", "rack", "(SELECT *, string_split(path, '/')[3] AS rack FROM fr WHERE type = 'socket' AND free > 0)"), _V, _E, _S, _T, _SEG, _F)
def match_hinode(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = policy.id_score(F.col("id"), F.col("rank"), F.col("rank") + model.NODE)
    racked = _sockets(spark, sf_dir).withColumn("rack", F.split("path", "/")[2])
    return policy.best(racked, F.lit(100).cast("bigint"), ["rack"], [score.desc(), F.col("uniq_id")], "free").select("uniq_id", "parent", "taken")


@query(_best_sql("high DESC, id", "25", "parent", "(SELECT *, max(id) OVER (PARTITION BY parent, island) AS high FROM (SELECT *, id - row_number() OVER (PARTITION BY parent ORDER BY id) AS island FROM fr WHERE type = 'socket' AND free > 0))"), _V, _E, _S, _T, _SEG, _F)
def match_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = policy.runs(_sockets(spark, sf_dir), ["parent"])
    return policy.best(placed, F.lit(25).cast("bigint"), ["parent"], [F.col("high").desc(), F.col("id")], "free").select("uniq_id", "parent", "taken")


@query("SELECT uniq_id, parent, score, place FROM (SELECT v.uniq_id, up.src AS parent, (1 + id % 7)::BIGINT AS score, row_number() OVER (PARTITION BY up.src ORDER BY id % 7, uniq_id)::INT AS place FROM v JOIN ed up ON up.dst = v.uniq_id WHERE type = 'node') WHERE place <= 2", _V, _E)
def match_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _held(spark, sf_dir).where("type = 'node'").join(closure.parents(model.edges(spark, sf_dir)), "uniq_id").withColumn("score", policy.variation_score(F.col("properties")))
    return policy.top(nodes, 2, ["parent"], [F.col("score"), F.col("uniq_id")]).select("uniq_id", "parent", "score", "place")


@query("SELECT uniq_id, parent, least(free, 10 - (upto - free)) AS taken FROM (SELECT *, sum(free) OVER (PARTITION BY parent ORDER BY free DESC, uniq_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(free) OVER (PARTITION BY parent)::BIGINT AS of_all FROM fr WHERE type = 'socket' AND free > 0) WHERE of_all >= 10 AND upto - free < 10", _V, _E, _S, _T, _SEG, _F)
def match_first_stop_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.best(_sockets(spark, sf_dir), F.lit(10).cast("bigint"), ["parent"], [F.col("free").desc(), F.col("uniq_id").desc()], "free").select("uniq_id", "parent", "taken")


def _noded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sockets by rack, with the node above."""
    return _sockets(spark, sf_dir).select("*", F.split("path", "/")[2].alias("rack"), F.col("rank").alias("node_id"), F.col("parent").alias("node"))


_RACKED = "(SELECT *, string_split(path, '/')[3] AS rack FROM fr WHERE type = 'socket' AND free > 0)"
_LONODE = _best_sql("(rank + 2) * 10000 + abs((rank + 100) % 10000 - 1) + id, uniq_id", "100", "rack", _RACKED)


@query("SELECT DISTINCT ch.parent AS node, cl.b AS uniq_id FROM (" + _LONODE + ") ch JOIN cl ON cl.a = ch.parent", _V, _E, _C, _S, _T, _SEG, _F)
def match_lonodex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low ids node by node, and all that is below the nodes that are then taken whole."""
    chosen = policy.choose(_noded(spark, sf_dir), F.lit(100).cast("bigint"), ["rack"], "lonodex", "free")
    return policy.whole_nodes(_kept(chosen.select("uniq_id"), "chosen"), _held(spark, sf_dir), _kept(_pairs(spark, sf_dir), "pairs"))


@query(_best_sql("free DESC, uniq_id DESC", "100", "rack", _RACKED), _V, _E, _S, _T, _SEG, _F)
def match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is met first: most free first."""
    return policy.choose(_noded(spark, sf_dir), F.lit(100).cast("bigint"), ["rack"], "first", "free").select("uniq_id", "parent", "taken")


@query("SELECT cl.a AS uniq_id, 1000000000 + ch.parent AS jobid, sum(taken)::BIGINT AS planned FROM (" + _best_sql("id") + ") ch JOIN cl ON cl.b = ch.uniq_id GROUP BY cl.a, ch.parent", _V, _E, _C, _S, _T, _SEG, _F)
def commit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What jobs hold on and above their pools, once each node's match is held by a job of its own."""
    chosen = policy.choose(_sockets(spark, sf_dir), F.lit(25).cast("bigint"), ["parent"], "low", "free")
    return update.tags(update.commit(chosen, F.col("parent") + 1_000_000_000, model.NOW, 30), _pairs(spark, sf_dir))


_MATCH = """
s1 AS (SELECT *, sum(free) OVER (PARTITION BY parent ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(free) OVER (PARTITION BY parent)::BIGINT AS of_all FROM fr WHERE type = 'socket' AND free > 0),
s AS (SELECT uniq_id, parent, least(free, 20 - (upto - free)) AS taken FROM s1 WHERE of_all >= 20 AND upto - free < 20),
n1 AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY id) AS place, count(*) OVER (PARTITION BY parent) AS of_all FROM fr WHERE type = 'node' AND uniq_id IN (SELECT parent FROM s)),
n AS (SELECT uniq_id, parent, 1::BIGINT AS taken FROM n1 WHERE of_all >= 2 AND place <= 2),
r1 AS (SELECT *, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS of_all FROM fr WHERE type = 'rack' AND uniq_id IN (SELECT parent FROM n)),
r AS (SELECT uniq_id, parent, 1::BIGINT AS taken FROM r1 WHERE of_all >= 2 AND place <= 2)"""


@query("SELECT 0 AS level, uniq_id, parent, taken FROM r UNION ALL SELECT 1, uniq_id, parent, taken FROM n WHERE parent IN (SELECT uniq_id FROM r) UNION ALL SELECT 2, uniq_id, parent, taken FROM s WHERE parent IN (SELECT uniq_id FROM n WHERE parent IN (SELECT uniq_id FROM r))", _V, _E, _S, _T, _SEG, _F, _MATCH)
def match_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = model.edges(spark, sf_dir).where("subsystem = 'containment'")
    # Each level reads the pools, so they are written once.
    return match.match(_kept(_free(spark, sf_dir), "free"), edges, [("rack", 2), ("node", 2), ("socket", 20)], [F.col("id"), F.col("uniq_id")])


@query("SELECT 1 AS variant, 0 AS level, uniq_id, parent, taken FROM r UNION ALL SELECT 1, 1, uniq_id, parent, taken FROM n WHERE parent IN (SELECT uniq_id FROM r) UNION ALL SELECT 1, 2, uniq_id, parent, taken FROM s WHERE parent IN (SELECT uniq_id FROM n WHERE parent IN (SELECT uniq_id FROM r))", _V, _E, _S, _T, _SEG, _F, _MATCH)
def match_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first choice asks for more racks than there are, so the second is taken, and not the third."""
    node = [{"type": "node", "count": 2, "with": [{"type": "socket", "count": 20}]}]
    asked = [{"type": "xor_slot", "count": n, "with": [{"type": "rack", "with": node}]} for n in (50, 2, 1)]
    chains = [requests.chain(v) for v in requests.variants(asked)]
    edges = model.edges(spark, sf_dir).where("subsystem = 'containment'")
    return match.match_either(_kept(_free(spark, sf_dir), "free"), edges, chains, [F.col("id"), F.col("uniq_id")])


@query("SELECT count(*) AS nodes FROM fr WHERE type = 'node' AND status = 'up' AND rank > 4 AND free > 0", _V, _E, _S, _T, _SEG, _F)
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.feasible_nodes(_free(spark, sf_dir), predicates.constraint({"ranks": ["5-24"]}))


@query("SELECT o_orderkey AS jobid, (1 + o_orderkey % 9) * 40 <= (SELECT sum(size) FROM v WHERE type = 'socket') AS possible FROM orders", _V)
def satisfiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all units of the graph would do for each job, whatever is held."""
    units = _held(spark, sf_dir).where("type = 'socket'").agg(F.sum("size").alias("units"))
    return model.table(spark, sf_dir, "orders").join(F.broadcast(units)).select(F.col("o_orderkey").alias("jobid"), ((1 + F.col("o_orderkey") % 9) * 40 <= F.col("units")).alias("possible"))


_COUNTS = """
pc AS (SELECT p_partkey AS k, (2 + p_partkey % 5)::BIGINT AS least, (2 + p_partkey % 97)::BIGINT AS most, (2 + p_partkey % 3)::BIGINT AS operand, p_size::BIGINT * 3 AS q FROM part),
se AS (SELECT k, least AS x, least AS p, 0 AS step FROM pc UNION ALL SELECT se.k, se.x * operand, se.p, step + 1 FROM se JOIN pc ON pc.k = se.k WHERE se.x * operand <= least(most, q)),
pw AS (SELECT k, least AS x FROM pc UNION ALL SELECT pw.k, pow(pw.x, operand)::BIGINT FROM pw JOIN pc ON pc.k = pw.k WHERE pow(pw.x, operand) <= least(most, q))"""


@query(
    "SELECT k, CASE WHEN least > most OR least > q THEN 0 ELSE least + (least(most, q) - least) // operand * operand END AS plus, CASE WHEN least > most OR least > q THEN 0 ELSE (SELECT max(x) FROM se WHERE se.k = pc.k) END AS times, CASE WHEN least > most OR least > q THEN 0 ELSE (SELECT max(x) FROM pw WHERE pw.k = pc.k) END AS power FROM pc",
    _COUNTS,
)
def calc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    series = {"plus": "+", "times": "*", "power": "^"}
    return model.table(spark, sf_dir, "part").select(key.alias("k"), *[counts.count(2 + key % 5, 2 + key % 97, F.lit(o), 2 + key % 3, F.col("p_size").cast("bigint") * 3).alias(n) for n, o in series.items()])


_SLOT = """
ch AS (SELECT l_orderkey AS parent, CASE WHEN l_linenumber % 2 = 0 THEN 'gpu' ELSE 'core' END AS type, l_linenumber::BIGINT * 1000000 + l_partkey AS id, l_quantity::BIGINT AS amount FROM lineitem),
nb AS (SELECT *, row_number() OVER (PARTITION BY parent, type ORDER BY id, amount) AS i FROM ch),
fo AS (SELECT parent, type, 0::BIGINT AS i, 0::BIGINT AS held, 0::BIGINT AS made FROM nb WHERE i = 1
 UNION ALL SELECT nb.parent, nb.type, nb.i, CASE WHEN held + amount >= need THEN 0 ELSE held + amount END, made + CASE WHEN held + amount >= need THEN 1 ELSE 0 END FROM fo JOIN nb ON nb.parent = fo.parent AND nb.type = fo.type AND nb.i = fo.i + 1 JOIN (SELECT 'gpu' AS type, 20 AS need UNION ALL SELECT 'core', 50) w ON w.type = nb.type),
mk AS (SELECT parent, type, max(made) AS made FROM fo GROUP BY parent, type),
sl AS (SELECT parent, CASE WHEN count(*) = 2 THEN min(made) ELSE 0 END AS slots FROM mk GROUP BY parent)"""


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 0, "gpu").otherwise("core")
    return model.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), kind.alias("type"), (F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_quantity").cast("bigint").alias("amount"))


@query("SELECT parent, slots FROM sl", _SLOT)
def slot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.slots(_children(spark, sf_dir), {"core": 50, "gpu": 20})


@query("SELECT coalesce(sl.parent, mk.parent) AS parent, CASE WHEN sl.slots > 0 THEN 0 ELSE 1 END AS variant, CASE WHEN sl.slots > 0 THEN sl.slots ELSE mk.made END AS slots FROM sl FULL JOIN (SELECT * FROM mk WHERE type = 'core') mk ON mk.parent = sl.parent WHERE sl.slots > 0 OR mk.made > 0", _SLOT)
def xor_slot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _children(spark, sf_dir)
    return match.either([match.slots(children, {"core": 50, "gpu": 20}), match.slots(children, {"core": 50})])


@query("SELECT fo.parent, fo.made - CASE WHEN fo.held = 0 THEN 1 ELSE 0 END AS slot, fo.type, nb.id, nb.amount FROM fo JOIN nb ON nb.parent = fo.parent AND nb.type = fo.type AND nb.i = fo.i JOIN sl ON sl.parent = fo.parent WHERE fo.made - CASE WHEN fo.held = 0 THEN 1 ELSE 0 END < sl.slots", _SLOT)
def slot_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.assembled(_children(spark, sf_dir), {"core": 50, "gpu": 20})


@query(
    "SELECT parent, max(i + j + (c - 50 * i - 30 * j) // 80)::BIGINT AS slots FROM (SELECT *, unnest(range(0, c // 30 + 1)) AS j FROM (SELECT *, unnest(range(0, c // 50 + 1)) AS i FROM (SELECT parent, coalesce(sum(amount) FILTER (type = 'core'), 0)::BIGINT AS c, coalesce(sum(amount) FILTER (type = 'gpu'), 0)::BIGINT AS g FROM ch GROUP BY parent))) WHERE c >= 50 * i + 30 * j AND g >= 20 * i + 40 * j GROUP BY parent",
    _SLOT.split("nb AS")[0].rstrip(",\n "),
)
def or_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.mixed_slots(_children(spark, sf_dir), [{"core": 50, "gpu": 20}, {"core": 30, "gpu": 40}, {"core": 80}])


_MANY = """
gr AS (SELECT (1000 + s_suppkey)::BIGINT AS v, (100 + s_nationkey)::BIGINT AS grp FROM supplier),
sh AS (SELECT gr.grp, seg.v, tm - 4 AS low, coalesce(until, 1 << 60) AS high FROM seg JOIN gr ON gr.v = seg.v WHERE remaining < 20),
ca AS (SELECT DISTINCT grp, high AS tm FROM sh WHERE high BETWEEN 1000 AND 1000000 UNION SELECT DISTINCT grp, 1000 FROM gr),
ok AS (SELECT ca.grp, ca.tm, (SELECT count(*) FROM gr WHERE gr.grp = ca.grp) - count(DISTINCT sh.v) AS n FROM ca LEFT JOIN sh ON sh.grp = ca.grp AND sh.low <= ca.tm AND sh.high > ca.tm GROUP BY ca.grp, ca.tm)"""


@query("SELECT grp, min(tm)::BIGINT AS tm FROM ok WHERE n >= 2 GROUP BY grp", _S, _T, _SEG, _MANY)
def match_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When first two sockets of a node have 20 units for five days."""
    groups = model.edges(spark, sf_dir).where("subsystem = 'containment' AND src >= 100").select(F.col("dst").alias("uniq_id"), F.col("src").alias("grp"))
    return timeline.earliest_for_many(_timeline(spark, sf_dir), groups, wanted=20, duration=5, members=2, after=1000)


# Changes of state.


@query("SELECT v AS uniq_id, count(*) AS spans, sum(n)::BIGINT AS units FROM sp WHERE jobid % 7 <> 1 GROUP BY v", _S)
def cancel_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = model.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 1").select(F.col("o_orderkey").alias("jobid"))
    return update.cancel(model.spans(spark, sf_dir), gone).groupBy("uniq_id").agg(F.count("*").alias("spans"), F.sum("planned").alias("units"))


def _on_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).where("type = 'socket' AND rank IN (1, 2, 3)").select("uniq_id")


_GONE = "gone AS (SELECT (1000 + s_suppkey)::BIGINT AS v FROM supplier WHERE s_nationkey IN (1, 2, 3))"


@query("SELECT jobid, count(*) FILTER (v IN (SELECT v FROM gone)) AS n_cancelled, count(*) FILTER (v IN (SELECT v FROM gone)) = count(*) AS \"full\" FROM sp GROUP BY jobid HAVING count(*) FILTER (v IN (SELECT v FROM gone)) > 0", _S, _GONE)
def partial_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update.cancelled_fully(model.spans(spark, sf_dir), _on_ranks(spark, sf_dir))


@query("SELECT v AS uniq_id, jobid, st, last, n AS planned FROM sp WHERE v NOT IN (SELECT v FROM gone)", _S, _GONE)
def cancel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update.cancel_on(model.spans(spark, sf_dir), _on_ranks(spark, sf_dir))


@query("SELECT v.type, count(*) AS pools, (SELECT count(*) FROM sp WHERE v NOT IN (SELECT cl.b FROM cl WHERE cl.a = 3)) AS spans FROM v WHERE v.type <> 'tenant' AND uniq_id NOT IN (SELECT cl.b FROM cl WHERE cl.a = 3) GROUP BY v.type", _V, _E, _C, _S)
def shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _held(spark, sf_dir).where("name = 'rack2'").select("uniq_id")
    pools, spans = update.shrink(_held(spark, sf_dir), model.spans(spark, sf_dir), _pairs(spark, sf_dir), root)
    return pools.groupBy("type").agg(F.count("*").alias("pools")).join(F.broadcast(spans.agg(F.count("*").alias("spans"))))


@query("SELECT rank, arg_min(uniq_id, (length(path), uniq_id)) AS uniq_id FROM v WHERE rank >= 0 GROUP BY rank", _V)
def mark_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update.rank_pools(_held(spark, sf_dir))


@query("SELECT uniq_id, CASE WHEN id % 2 = 0 THEN 'down' ELSE status END AS status, id % 3 = 0 AS has_tag, CASE WHEN id % 3 = 0 THEN 'x' END AS tag, id % 5 <> 0 AS has_class FROM v WHERE type = 'node'", _V)
def set_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = update.set_status(_held(spark, sf_dir).where("type = 'node'"), F.col("id") % 2 == 0, "down")
    nodes = update.remove_property(update.set_property(nodes, F.col("id") % 3 == 0, "tag", "x"), F.col("id") % 5 == 0, "perf_class")
    tagged = F.element_at("properties", "tag")
    return nodes.select("uniq_id", "status", F.map_contains_key("properties", F.lit("tag")).alias("has_tag"), tagged.alias("tag"), F.map_contains_key("properties", F.lit("perf_class")).alias("has_class"))


@query("SELECT DISTINCT a.v AS uniq_id, a.jobid, a.st, a.last FROM sp a JOIN sp b ON a.v = b.v AND a.jobid <> b.jobid AND b.st < a.last AND b.last > a.st", _S)
def update_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = model.spans(spark, sf_dir)
    return update.conflicts(spans, spans.select("uniq_id", "jobid", "st", "last").distinct())


_LATE = "lt AS (SELECT (1000 + min(l_suppkey))::BIGINT AS v, o_orderkey + 1000000000000000 AS jobid, 2 * datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)"


@query("SELECT v AS uniq_id, count(*) AS spans, count(*) FILTER (jobid >= 100000000000000) AS added FROM (SELECT v, jobid FROM sp UNION ALL SELECT v, jobid FROM lt WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.v = lt.v AND sp.st < lt.st + 10 AND sp.last > lt.st)) GROUP BY v", _S, _LATE)
def update_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans after jobs were put on their first pool at twice their day, but for those whose pool is held then."""
    new = _new(spark, sf_dir).withColumns({"st": F.col("st") * 2, "last": F.col("st") * 2 + 10})
    spans, _ = update.apply(model.spans(spark, sf_dir), new)
    return spans.groupBy("uniq_id").agg(F.count("*").alias("spans"), F.count_if(F.col("jobid") >= 100_000_000_000_000).alias("added"))


@query("SELECT uniq_id, path, size FROM v WHERE type <> 'tenant' UNION ALL SELECT 20000000 + uniq_id, '/cluster1' || substr(path, 10), size FROM v WHERE type IN ('rack', 'node')", _V)
def grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with a second cluster's racks and nodes grafted; what is there already isn't added again."""
    pools = _held(spark, sf_dir)
    second = pools.where("type IN ('rack', 'node')").withColumns({"uniq_id": F.col("uniq_id") + 20_000_000, "path": F.concat(F.lit("/cluster1"), F.expr("substring(path, 10)"))})
    return update.graft(pools, second.unionByName(pools.where("type = 'rack'"))).select("uniq_id", "path", "size")


@query("SELECT uniq_id, path FROM v WHERE type <> 'tenant' AND uniq_id NOT IN (SELECT cl.b FROM cl WHERE cl.a IN (SELECT uniq_id FROM v WHERE status = 'down'))", _V, _E, _C)
def remove_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools without those that are down and all below these."""
    pools = _held(spark, sf_dir)
    return update.prune(pools, _pairs(spark, sf_dir), pools.where("status = 'down'").select("uniq_id")).select("uniq_id", "path")


@query("SELECT src AS parent FROM ed WHERE src >= 100 AND subsystem = 'containment' GROUP BY src HAVING bool_and(dst IN (SELECT v FROM sp WHERE st <= 400 AND last > 400))", _E, _S)
def node_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = model.edges(spark, sf_dir).where("subsystem = 'containment' AND src >= 100").select(F.col("src").alias("parent"), F.col("dst").alias("uniq_id"))
    return update.promoted(children, model.spans(spark, sf_dir).where(f"st <= {model.NOW} AND last > {model.NOW}").select("uniq_id"))


@query("SELECT coalesce(max(l_orderkey) + 1, 0) AS jobid FROM lineitem")
def next_jobid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.spans(spark, sf_dir).agg(F.coalesce(F.max("jobid") + 1, F.lit(0)).alias("jobid"))


# Waiting lines.

_J = """
jb AS (SELECT o_orderkey AS jobid, c_mktsegment AS queue, substr(o_orderpriority, 1, 1)::BIGINT AS priority, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t_submit, 1 + o_orderkey % 30 AS duration, 1 + o_orderkey % 8 AS nodes FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("SELECT queue, jobid, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, t_submit, jobid)::INT AS place FROM jb", _J)
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lines(model.jobs(spark, sf_dir)).select("queue", "jobid", "place")


@query("SELECT queue, jobid, place FROM (SELECT queue, jobid, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, t_submit, jobid)::INT AS place FROM jb) WHERE place <= 32", _J)
def queue_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lines(model.jobs(spark, sf_dir), depth=32).select("queue", "jobid", "place")


@query("SELECT queue, CASE WHEN t_submit > 400 THEN 'pending' WHEN t_submit + duration > 400 THEN 'running' ELSE 'complete' END AS state, count(*) AS jobs FROM jb GROUP BY ALL", _J)
def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("t_submit") > model.NOW, "pending").when(F.col("t_submit") + F.col("duration") > model.NOW, "running").otherwise("complete")
    return jobs.counters(model.jobs(spark, sf_dir), state)


@query("SELECT jobid, round, estimate FROM (SELECT *, lag(estimate) OVER w AS b, row_number() OVER w AS i FROM (SELECT jobid, n AS round, max(last // 30) AS estimate FROM sp GROUP BY jobid, n) WINDOW w AS (PARTITION BY jobid ORDER BY round)) WHERE i = 1 OR estimate IS DISTINCT FROM b", _S)
def estimate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = model.spans(spark, sf_dir).groupBy("jobid", F.col("planned").alias("round")).agg(F.max(F.floor(F.col("last") / 30)).alias("estimate"))
    return jobs.changed_estimates(rounds)


# Sources and sinks.


@query(
    "SELECT o_orderkey AS jobid, '0' AS req, NULL::VARCHAR AS parent, 0 AS depth, 'node' AS type, 1 + o_orderkey % 3 AS cmin, 1 + o_orderkey % 3 + 4 AS cmax, '*' AS oper, 2 AS operand, true AS exclusive, NULL::VARCHAR AS label, (o_orderkey % 5 * 2 + 1)::BIGINT AS duration FROM orders UNION ALL SELECT o_orderkey, '0.0', '0', 1, 'slot', 1, 1, '+', 1, NULL, 'task', o_orderkey % 5 * 2 + 1 FROM orders UNION ALL SELECT o_orderkey, '0.0.0', '0.0', 2, 'core', 2, 2, '+', 1, NULL, NULL, o_orderkey % 5 * 2 + 1 FROM orders UNION ALL SELECT o_orderkey, '0.0.1', '0.0', 2, 'gpu', 1, 1, '+', 1, NULL, NULL, o_orderkey % 5 * 2 + 1 FROM orders"
)
def jobspec_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    slot = '{"type": "slot", "count": 1, "label": "task", "with": [{"type": "core", "count": 2}, {"type": "gpu", "count": 1}]}'
    text = F.format_string('{"version": 1, "resources": [{"type": "node", "count": {"min": %d, "max": %d, "operator": "*", "operand": 2}, "exclusive": true, "with": [' + slot + ']}], "attributes": {"system": {"duration": %d.5}}}', 1 + key % 3, 5 + key % 3, key % 5 * 2)
    return requests.requests(model.table(spark, sf_dir, "orders").select(key.alias("jobid"), text.alias("jobspec")))


@query(
    "SELECT 'cluster' AS type, 0::BIGINT AS id, '/cluster0' AS path UNION ALL SELECT 'rack', r, '/cluster0/rack' || r FROM range(3) t(r) UNION ALL SELECT 'node', r * 4 + n, '/cluster0/rack' || r || '/node' || (r * 4 + n) FROM range(3) t(r), range(4) u(n) UNION ALL SELECT 'core', 100 + 2 * ((r * 4 + n) * 6 + c), '/cluster0/rack' || r || '/node' || (r * 4 + n) || '/core' || (100 + 2 * ((r * 4 + n) * 6 + c)) FROM range(3) t(r), range(4) u(n), range(6) w(c)"
)
def recipe_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.expand(spark, "cluster", [("rack", 3, 0, 1), ("node", 4, 0, 1), ("core", 6, 100, 2)])


@query("SELECT uniq_id, type, name, id, rank, size, status, false AS exclusive, path FROM v WHERE type <> 'tenant'", _V)
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "graph")
    writers.write_graphs(_held(spark, sf_dir), model.edges(spark, sf_dir).where("subsystem = 'containment'"), path)
    return readers.read_graphs(spark, path)[0].drop("properties")


@query("SELECT ranks, children FROM " + _ranges("(SELECT s_nationkey::BIGINT AS rank, 'socket=' || ids AS children FROM " + _ranges("supplier", "s_nationkey", "s_suppkey", "ids") + ")", "children", "rank", "ranks"))
def rlite_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.rank_lists(_held(spark, sf_dir).where("type = 'socket'").select("rank", "type", "id"))


@query("SELECT s_nationkey::BIGINT AS rank, 'socket' AS type, s_suppkey AS id FROM supplier")
def resources_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = writers.rank_lists(_held(spark, sf_dir).where("type = 'socket'").select("rank", "type", "id"))
    text = writers.resources(lists, 0, 100)
    return readers.rank_units(text.select(F.from_json("resources", readers.RESOURCES).alias("r")).select("r.*"))


@query(
    "SELECT type, name, id, rank, path, has FROM (SELECT 'cluster' AS type, 'cluster0' AS name, 0::BIGINT AS id, -1::BIGINT AS rank, '/cluster0' AS path, 0 AS has UNION ALL SELECT 'node', 'node' || n_nationkey, n_nationkey, n_nationkey, '/cluster0/node' || n_nationkey, 2 FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'socket', 'socket' || s_suppkey, s_suppkey, s_nationkey, '/cluster0/node' || s_nationkey || '/socket' || s_suppkey, 0 FROM supplier)"
)
def resource_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of what ranks hold, written with hosts and properties and read as a graph."""
    sockets = _held(spark, sf_dir).where("type = 'socket'").select("rank", "type", "id")
    nodes = _held(spark, sf_dir).where("type = 'node'").join(sockets.select("rank").distinct(), "rank", "left_semi")
    text = writers.resources(writers.rank_lists(sockets), 0, 100, nodes.select("rank", F.col("name").alias("host")), writers.property_ranks(nodes))
    vertices, _ = readers.rank_graph(text.select(F.from_json("resources", readers.RESOURCES).alias("r")).select("r.*"))
    return vertices.select("type", "name", "id", "rank", "path", F.size("properties").alias("has"))


@query("SELECT uniq_id, repeat('   ', len(string_split(path, '/')) - 2) || name || '[' || size || ':' || CASE WHEN type = 'socket' THEN 'exclusive' ELSE 'shared' END || ']' AS line, path AS place FROM v WHERE type <> 'tenant'", _V)
def pretty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).select("uniq_id", writers.line(F.col("size"), F.col("type") == "socket", long=True).alias("line"), writers.sort_key().alias("place"))


@query("SELECT 'socket' AS type, i AS id, '/r' || r_regionkey || '/socket' || i AS path FROM (SELECT r_regionkey, unnest(range(r_regionkey * 3, r_regionkey * 3 + 3)) AS i FROM region)")
def recipe_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pools below each row of a table."""
    above = model.table(spark, sf_dir, "region").select(F.concat(F.lit("/r"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_regionkey").cast("bigint").alias("ordinal"))
    return readers.multiply(above, "socket", F.lit(3)).drop("ordinal")


@query("SELECT property, ranks FROM " + _ranges("(SELECT n_nationkey::BIGINT AS rank, n_name AS property FROM nation UNION ALL SELECT n_nationkey, 'perf_class=' || n_nationkey % 7 FROM nation)", "property", "rank", "ranks"))
def property_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.property_ranks(_held(spark, sf_dir).where("type = 'node'"))


@query("SELECT l_suppkey AS k, idset FROM " + _ranges("(SELECT l_suppkey, datediff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS id FROM lineitem)", "l_suppkey", "id", "idset"))
def idset_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), model.day(F.col("l_shipdate")).alias("id"))
    return idset.encode(rows, ["k"], "id")


@query("SELECT uniq_id, repeat('   ', len(string_split(path, '/')) - 2) || name || '[' || size || ':' || CASE WHEN type = 'socket' THEN 'x' ELSE 's' END || ']' AS line, path || '~' AS place FROM v WHERE type <> 'tenant'", _V)
def simple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).select("uniq_id", writers.line(F.col("size"), F.col("type") == "socket").alias("line"), writers.sort_key(depth_first=True).alias("place"))


@query("SELECT c_custkey AS k, coalesce(nullif(regexp_extract(c_name, '(\\d+)$', 1), '')::BIGINT, -1) AS number FROM customer")
def host_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), counts.host_number(F.col("c_name")).alias("number"))


@query("SELECT a.uniq_id AS src, b.uniq_id AS dst FROM v a JOIN v b ON a.type = 'socket' AND b.type = 'tenant' AND regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '')", _V)
def associate_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = model.vertices(spark, sf_dir)
    return readers.associate(pools.where("type = 'socket'"), pools.where("type = 'tenant'"), counts.path_above(F.col("path"), 1))


@query("SELECT s_nationkey::BIGINT AS rank, 'socket' AS type, CASE WHEN s_nationkey BETWEEN 3 AND 9 AND s_suppkey = 7 THEN 700 WHEN s_nationkey BETWEEN 10 AND 30 AND s_suppkey = 7 THEN 701 ELSE s_suppkey END AS id FROM supplier")
def namespace_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(3, 9, "socket", 7, 700), (10, 30, "socket", 7, 701)], "low bigint, high bigint, type string, ref bigint, new bigint")
    return readers.remap(_held(spark, sf_dir).where("type = 'socket'").select("rank", "type", "id"), ranges)


@query("SELECT uniq_id FROM v WHERE uniq_id = 0 OR uniq_id IN (SELECT b FROM cl WHERE a IN (2, 104))", _V, _E, _C)
def shorthand_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(0, False), (2, True), (104, True)], "uniq_id bigint, exclusive boolean")
    return readers.shorthand(_held(spark, sf_dir), _pairs(spark, sf_dir), given).select("uniq_id")


@query("SELECT dst AS uniq_id, dst % 3 = 0 AS exclusive FROM ed WHERE subsystem = 'containment' AND src % 3 <> 0 UNION ALL SELECT dst, dst % 3 = 0 FROM ed WHERE subsystem = 'containment' AND src = 0", _E)
def graph_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools without those that an exclusive parent stands for; the root is not among them."""
    edges = model.edges(spark, sf_dir).where("subsystem = 'containment'")
    chosen = edges.select(F.col("dst").alias("uniq_id"), (F.col("dst") % 3 == 0).alias("exclusive"))
    return writers.without_implied(chosen, edges)


# Outcomes, and why pools are left.

_NA = """
na AS (SELECT fr.parent AS node, (coalesce(sum(fr.free) FILTER (fr.status = 'up' AND up.status = 'up'), 0))::BIGINT AS now, sum(greatest(coalesce(t.total, 0), fr.size))::BIGINT AS ever FROM fr JOIN v up ON up.uniq_id = fr.parent LEFT JOIN (SELECT DISTINCT v, total FROM tl) t ON t.v = fr.uniq_id WHERE fr.type = 'socket' GROUP BY fr.parent)"""


@query("SELECT o_orderkey AS jobid, CASE WHEN (SELECT count(*) FROM na WHERE now >= 10 * (o_orderkey % 40)) >= 1 + o_orderkey % 27 THEN 'matched' WHEN (SELECT count(*) FROM na WHERE ever >= 10 * (o_orderkey % 40)) >= 1 + o_orderkey % 27 THEN 'busy' ELSE 'impossible' END AS outcome FROM orders", _V, _E, _S, _T, _SEG, _F, _NA)
def match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for some nodes with so much in sockets: had now, busy, or impossible with all nodes up and free."""
    up = _held(spark, sf_dir).where("type = 'node'").select(F.col("uniq_id").alias("parent"), F.col("status").alias("above"))
    placed = _free(spark, sf_dir, F.max("total").alias("total")).where("type = 'socket'").join(closure.parents(model.edges(spark, sf_dir)), "uniq_id").join(up, "parent")
    now = F.sum(F.when((F.col("status") == "up") & (F.col("above") == "up"), F.col("free")).otherwise(0))
    nodes = _kept(placed.groupBy("parent").agg(now.alias("now"), F.sum(F.greatest(F.coalesce("total", F.lit(0)), "size")).alias("ever")), "outcomes")
    key = F.col("o_orderkey")
    asked = model.table(spark, sf_dir, "orders").select(key.alias("jobid"), (1 + key % 27).alias("count"), (10 * (key % 40)).alias("need"))
    return match.outcomes(asked, nodes.select(F.col("now").alias("amount")), nodes.select(F.col("ever").alias("amount")))


@query(
    "SELECT own.uniq_id, CASE WHEN own.uniq_id IN (SELECT cl.b FROM cl JOIN own o ON o.uniq_id = cl.a WHERE depth > 0 AND o.reason IS NOT NULL) THEN 'above' ELSE own.reason END AS reason FROM own",
    _V, _E, _C, _S, _T, _SEG, _F,
    "own AS (SELECT uniq_id, CASE WHEN status <> 'up' THEN 'status' WHEN id % 5 = 4 THEN 'constraint' WHEN free < 1 THEN 'availability' WHEN uniq_id IN (SELECT cl.a FROM cl JOIN sp ON sp.v = cl.b WHERE st < 20 AND last > 10 AND jobid % 9 = 0) THEN 'exclusivity' WHEN uniq_id IN (SELECT cl.a FROM cl JOIN fr f ON f.uniq_id = cl.b WHERE depth > 0 AND f.type = 'socket' GROUP BY cl.a HAVING sum(f.free) < 60) THEN 'subtree' END AS reason FROM fr WHERE type IN ('rack', 'node', 'socket'))",
)
def prune_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a search for pools with 60 free sockets below them leaves racks, nodes and sockets; some jobs' pools are had exclusively."""
    spans = model.spans(spark, sf_dir)
    busy = spans.where("st < 20 AND last > 10 AND jobid % 9 = 0").select("uniq_id").distinct()
    pools = _kept(_free(spark, sf_dir).where("type IN ('rack', 'node', 'socket')"), "pruned")
    return match.pruned(pools, _pairs(spark, sf_dir), F.col("id") % 5 != 4, 1, busy, {"socket": 60})


@query("SELECT uniq_id, path FROM v WHERE type = 'tenant' AND uniq_id NOT IN (SELECT dst FROM ed WHERE subsystem = 'storage' AND src NOT IN (SELECT parent FROM fr WHERE type = 'socket' GROUP BY parent HAVING sum(free) >= 60))", _V, _E, _S, _T, _SEG, _F)
def match_auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants whose nodes, above them in the subsystem of storage, have 60 free in sockets."""
    storage = closure.closure(model.edges(spark, sf_dir).where("subsystem = 'storage'"), levels=1)
    nodes = _sockets(spark, sf_dir).groupBy(F.col("parent").alias("uniq_id")).agg(F.sum("free").alias("amount"))
    return match.supported(model.vertices(spark, sf_dir).where("type = 'tenant'"), storage, nodes, 60).select("uniq_id", "path")


@query("SELECT parent, count(*) AS pools, sum(taken)::BIGINT AS units, sum(id + 2)::BIGINT AS score FROM (" + _best_sql("id", extra=", id") + ") GROUP BY parent", _V, _E, _S, _T, _SEG, _F)
def match_score_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = policy.choose(_sockets(spark, sf_dir), F.lit(25).cast("bigint"), ["parent"], "low", "free")
    return policy.score_sums(chosen, ["parent"], policy.id_score(F.col("id")))


@query("SELECT uniq_id, up.src AS parent, row_number() OVER w::INT AS place, (sum(id + 2) OVER w)::BIGINT AS upto FROM v JOIN ed up ON up.dst = v.uniq_id WHERE type = 'socket' WINDOW w AS (PARTITION BY up.src ORDER BY id DESC)", _V, _E)
def match_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sockets of a node in order of score, with the sum of scores so far."""
    placed = _held(spark, sf_dir).where("type = 'socket'").join(closure.parents(model.edges(spark, sf_dir)), "uniq_id")
    score = policy.id_score(F.col("id"))
    return policy.every(placed, ["parent"], [score.desc(), F.col("uniq_id")], score).select("uniq_id", "parent", "place", "upto")


@query("SELECT cl.a AS anchor FROM cl JOIN v ON v.uniq_id = cl.b WHERE depth > 0 GROUP BY cl.a HAVING sum(v.size) FILTER (v.type = 'socket') >= 12", _V, _E, _C)
def flexible_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools that may have room for either of two shapes: of what both need, the least decides."""
    wanted = rollup.least_wanted([{"socket": 30, "node": 3}, {"socket": 12, "rack": 9}])
    return rollup.anchors_with(rollup.subtree_totals(_held(spark, sf_dir), _pairs(spark, sf_dir), rollup.tracked_types("ALL:socket,ALL:node")), wanted)


@query("SELECT jobid, CASE WHEN min(st) > 400 THEN 'reserved' WHEN max(last) > 400 THEN 'allocated' ELSE 'done' END AS state, min(st) AS \"at\", max(last) AS until, count(DISTINCT v) AS pools FROM sp GROUP BY jobid", _S)
def job_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.info(model.spans(spark, sf_dir), model.NOW)


@query("SELECT count(*) AS njobs, count(*) FILTER (st >= 400) AS njobs_reset, max(w) AS most FROM (SELECT jobid, min(st) AS st, max(last - st) AS w FROM sp GROUP BY jobid)", _S)
def match_stats_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = model.spans(spark, sf_dir).groupBy("jobid").agg(F.max(F.col("last") - F.col("st")).alias("w"), F.min("st").alias("st"))
    return rollup.match_statistics(times, "w", "jobid", F.col("st") >= model.NOW).select("njobs", "njobs_reset", "most")


@query("SELECT s_nationkey::BIGINT AS rank_of, bool_and(s_suppkey % 50 <> 7) AS same FROM supplier GROUP BY s_nationkey")
def resources_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ranks hold the same, when every fiftieth socket is gone; compressed lists of one side are decoded."""
    a = _held(spark, sf_dir).where("type = 'socket'").select("rank", "type", "id")
    text = writers.resources(writers.rank_lists(a.where("id % 50 != 7")), 0, 100)
    b = readers.rank_units(text.select(F.from_json("resources", readers.RESOURCES).alias("r")).select("r.*"))
    return readers.same_units(a.withColumn("rank_of", F.col("rank")), b.withColumn("rank_of", F.col("rank").cast("bigint")), ["rank_of"])


@query("SELECT s_suppkey AS id, 'socket' AS type, '/cluster0/node' || s_nationkey || '/socket' || s_suppkey AS path, '/cluster0/node' || s_nationkey AS above FROM supplier UNION ALL SELECT DISTINCT s_nationkey, 'node', '/cluster0/node' || s_nationkey, '/cluster0' FROM supplier")
def resources_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranks hold, written as a graph, read again, with the paths of parents."""
    sockets = _held(spark, sf_dir).where("type = 'socket'").select("rank", "type", "id")
    hosts = sockets.select("rank").distinct().select("rank", F.concat(F.lit("node"), F.col("rank").cast("string")).alias("host"))
    text = writers.resources(writers.rank_lists(sockets), 0, 100, hosts)
    vertices, edges = readers.graph_rows(*readers.rank_graph(text.select(F.from_json("resources", readers.RESOURCES).alias("r")).select("r.*")))
    path = _scratch(spark, "ranks")
    writers.write_graphs(vertices, edges, path)
    read, links = readers.read_graphs(spark, path)
    above = read.select(F.col("uniq_id").alias("src"), F.col("path").alias("above"))
    return read.join(links.select("src", F.col("dst").alias("uniq_id")), "uniq_id").join(above, "src").select("id", "type", "path", "above")


@query("SELECT '/cluster0' AS path, 'cluster' AS type UNION ALL SELECT path, type FROM v WHERE type = 'rack'", _V)
def resources_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole racks in a list of ranks, with a graph that names what stands for all below it."""
    pools = _held(spark, sf_dir)
    chosen = writers.without_implied(pools.select("uniq_id", (F.col("type") == "rack").alias("exclusive")), model.edges(spark, sf_dir).where("subsystem = 'containment'"))
    chosen = chosen.join(_pairs(spark, sf_dir).where("depth > 0").join(pools.where("type = 'rack'").select(F.col("uniq_id").alias("anc")), "anc", "left_semi").select(F.col("desc").alias("uniq_id")), "uniq_id", "left_anti")
    nodes = pools.join(chosen.select("uniq_id", "exclusive"), "uniq_id").select(writers.node_json(F.col("exclusive")).alias("node"))
    graph = nodes.agg(F.to_json(F.struct(F.struct(F.collect_list("node").alias("nodes")).alias("graph"))).alias("graph"))
    text = writers.resources(writers.rank_lists(pools.where("type = 'socket'").select("rank", "type", "id")), 0, 100, graph=graph)
    read = text.select(F.from_json("resources", f"scheduling struct<{readers.GRAPH.replace('graph struct', 'graph: struct', 1)}>").alias("r")).select("r.scheduling.graph")
    return readers.graph(read)[0].select("path", "type")


# Streams.

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n, count(*)::BIGINT AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, of days that no event can be late for any more."""
    events = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    return streams.drain(streams.windowed(events, "event_type", F.lit(1)), _scratch(spark, "windows"))


@query("SELECT user_id AS uniq_id, arg_max(event_id, event_id) AS seq, CASE WHEN bool_or(event_type = 'purchase') THEN 'lost' ELSE CASE WHEN arg_max(event_type, event_id) = 'click' THEN 'down' ELSE 'up' END END AS state FROM events GROUP BY user_id HAVING CASE WHEN bool_or(event_type = 'purchase') THEN 'lost' ELSE CASE WHEN arg_max(event_type, event_id) = 'click' THEN 'down' ELSE 'up' END END <> 'up'")
def stream_pool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as pools: a click takes one down, a purchase away for good, what else brings it up."""
    events = spark.readStream.schema(_EVENTS).parquet(_folder(spark, sf_dir))
    change = F.when(F.col("event_type") == "purchase", "shrink").when(F.col("event_type") == "click", "down").otherwise("up")
    stated = streams.pool_states(events.select(F.col("user_id").alias("uniq_id"), F.col("event_id").alias("seq"), change.alias("change")))
    return streams.drain(stated, _scratch(spark, "states"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The events in a folder of their own, as a stream reads folders."""
    path = _scratch(spark, "events")
    model.table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").write.parquet(path)
    return path
