import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from poolframe.functions import counts, idset
from poolframe.operators import closure, find, jobs, match, policy, predicates, rollup, update
from poolframe.sources import readers, requests, writers


@pytest.fixture(scope="module")
def tiny(spark):
    """cluster 0 - racks 1, 2 - nodes 10..13 - cores 100..107."""
    rows = [(0, "cluster", 0, -1, "up", "/cluster0", {})]
    edges = []
    for r in (1, 2):
        rows.append((r, "rack", r, -1, "up", f"/cluster0/rack{r}", {}))
        edges.append((0, r))
        for n in (0, 1):
            node = 10 + 2 * (r - 1) + n
            rows.append((node, "node", node, node - 10, "down" if node == 11 else "up", f"/cluster0/rack{r}/node{node}", {"fast": "", "perf_class": str(node)}))
            edges.append((r, node))
            for c in (0, 1):
                core = 100 + 2 * (node - 10) + c
                rows.append((core, "core", core, node - 10, "up", f"/cluster0/rack{r}/node{node}/core{core}", {}))
                edges.append((node, core))
    vertices = spark.createDataFrame([(i, t, f"{t}{k}", k, rank, 1, s, p, m) for i, t, k, rank, s, p, m in rows], "uniq_id long, type string, name string, id long, rank long, size long, status string, path string, properties map<string,string>")
    edges = spark.createDataFrame(edges, "src long, dst long")
    spans = spark.createDataFrame([(100, 7, 0, 10, 1), (104, 8, 20, 30, 1), (105, 7, 5, 6, 1)], "uniq_id long, jobid long, st long, last long, planned long")
    return vertices, edges, spans, closure.closure(edges, 3)


def ids(df, column="uniq_id"):
    return sorted(r[column] for r in df.collect())


def test_closure(tiny):
    _, _, _, pairs = tiny
    assert pairs.count() == 15 + 14 + 12 + 8
    spark = pairs.sparkSession
    one = spark.createDataFrame([(12,)], "uniq_id long")
    assert ids(closure.descendants(pairs, one)) == [12, 104, 105] and ids(closure.ancestors(pairs, one)) == [0, 2, 12]


@pytest.mark.parametrize(
    "text, hits",
    [
        ("status=down", [11, 102, 103]),
        ("sched-now=allocated", [100]),
        ("sched-future=reserved", [104, 105]),
        ("jobid-alloc=7", [100]),
        ("property=fast and status=up", [10, 12, 13]),
        ("property=fast status=up", [10, 12, 13]),
        ("names=core[100-101],node13", [13, 100, 101]),
        ("jobid-alloc=7 or jobid-reserved=8 and status=down", []),
        ("jobid-alloc=7 or (jobid-reserved=8 and status=up)", [100, 104]),
        ("jobid-tag=8", [0, 2, 12, 104]),
        ("agfilter=t", None),
    ],
)
def test_find(tiny, text, hits):
    vertices, _, spans, pairs = tiny
    stated = find.states(vertices, spans, pairs, 3, predicates.jobs_of(text))
    got = find.find(stated, pairs, predicates.criteria(text))
    assert ids(got.where("hit")) == (hits if hits is not None else ids(vertices))
    if hits == [100]:
        assert ids(got) == [0, 1, 10, 100]


@pytest.mark.parametrize("text", ["", "status", "status=sideways", "and status=up", "(status=up", "status=up)", "status=up or", "jobid-alloc=x", "colour=red", "()"])
def test_invalid_criteria(text):
    with pytest.raises(ValueError):
        predicates.criteria(text)


def test_extract():
    assert predicates.extract("status=up and (names=a or property=k=v)") == [("status", "up"), ("names", "a"), ("property", "k=v")]


@pytest.mark.parametrize(
    "spec, nodes",
    [
        (None, [10, 11, 12, 13]),
        ({"properties": ["fast"]}, [10, 11, 12, 13]),
        ({"properties": ["^fast"]}, []),
        ({"hostlist": ["node[10-11]", "node13"]}, [10, 11, 13]),
        ({"ranks": ["0,2-3"]}, [10, 12, 13]),
        ({"not": [{"ranks": ["0-1"]}, {"hostlist": ["node10"]}]}, [11, 12, 13]),
        ({"or": [{"ranks": ["0"]}, {"hostlist": ["node13"]}]}, [10, 13]),
        ({"and": []}, [10, 11, 12, 13]),
    ],
)
def test_constraints(tiny, spec, nodes):
    vertices = tiny[0]
    assert ids(vertices.where("type = 'node'").where(predicates.node_constraint(spec))) == nodes
    assert vertices.where("type = 'core'").where(predicates.node_constraint(spec)).count() == 8


@pytest.mark.parametrize("spec", [{"properties": ["a|b"]}, {"properties": "fast"}, {"near": ["x"]}, {"ranks": ["0"], "hostlist": ["a"]}])
def test_invalid_constraints(spec):
    with pytest.raises(ValueError):
        predicates.constraint(spec)


def test_rollups(tiny):
    vertices, _, spans, pairs = tiny
    totals = {(r.anchor, r.rtype): r.total for r in rollup.subtree_totals(vertices, pairs, {"ALL": ["core"], "rack": ["node"]}).collect()}
    assert totals[0, "core"] == 8 and totals[1, "node"] == 2 and (0, "node") not in totals and totals[11, "core"] == 2
    assert {(r.anchor, r.used) for r in rollup.subtree_usage(spans, vertices, pairs, 5).collect()} == {(0, 2), (1, 1), (2, 1), (10, 1), (12, 1)}
    assert [(r.size, r.ranks) for r in rollup.rank_histogram(vertices, pairs).collect()] == [(3, "0-3")]


def test_statistics(spark):
    (r,) = rollup.match_statistics(spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 4.0)], "job long, t double"), "t", "job").collect()
    assert (r.njobs, r.least, r.most, r.most_job, round(r.average, 4), round(r.variance, 4)) == (3, 2.0, 4.0, 2, 3.3333, 0.8889)
    (r,) = rollup.match_statistics(spark.createDataFrame([(1, 2.0)], "job long, t double"), "t", "job").collect()
    assert (r.average, r.variance) == (0.0, 0.0)


@pytest.mark.parametrize(
    "least, most, operator, operand, qualified, want",
    [(1, 10, "+", 2, 6, 5), (1, 10, "+", 2, 10, 9), (2, 100, "*", 2, 33, 32), (2, 100, "^", 2, 255, 16), (2, 1000, "^", 2, 256, 256), (5, 4, "+", 1, 9, 0), (5, 9, "+", 1, 4, 0), (3, 243, "*", 3, 243, 243), (1, 9, "^", 2, 9, 1), (4, 4, "*", 2, 100, 4)],
)
def test_counts(spark, least, most, operator, operand, qualified, want):
    cells = [F.lit(x).cast("bigint") if not isinstance(x, str) else F.lit(x) for x in (least, most, operator, operand, qualified)]
    assert spark.range(1).select(counts.count(*cells).alias("c")).collect()[0].c == want


def test_names_and_paths(spark):
    df = spark.createDataFrame([("node007", "/a/b/c"), ("x", "/a"), ("12", "")], "name string, path string")
    assert [r.n for r in df.select(counts.host_number(F.col("name")).alias("n")).collect()] == [7, -1, 12]
    assert [r.p for r in df.select(counts.path_above(F.col("path"), 1).alias("p")).collect()] == ["/a/b", None, None]


def test_idsets(spark):
    assert idset.members("0-3,7") == ["0", "1", "2", "3", "7"] and idset.members("node[08-10],r1") == ["node08", "node09", "node10", "r1"]
    rows = spark.createDataFrame([("a", i) for i in (5, 0, 1, 2, 7, 2)] + [("b", 4), ("c", None)], "k string, i long")
    coded = idset.encode(rows, ["k"], "i")
    assert {r.k: r.idset for r in coded.collect()} == {"a": "0-2,5,7", "b": "4"}
    assert sorted(tuple(r) for r in idset.decode(coded, "idset").select("k", "id").collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 5), ("a", 7), ("b", 4)]


def test_policies():
    assert policy.policy("lonodex") == policy.Policy(False, True, True) and policy.policy("policy=low stop_on_1_matches=true").stop_on_first
    for text in ("policy=best", "node_centric=maybe", "nonsense"):
        with pytest.raises(ValueError):
            policy.policy(text)


def test_best(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 3, 5), ("b", 4, 2)], "g string, id long, amount long")
    got = policy.best(rows, F.lit(6), ["g"], [F.col("id").desc()]).collect()
    assert {(r.id, r.taken) for r in got} == {(3, 5), (2, 1)}
    runs = {r.id: (r.low, r.high) for r in policy.runs(spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 8)], "g string, id long"), ["g"]).collect()}
    assert runs == {1: (1, 3), 2: (1, 3), 3: (1, 3), 7: (7, 8), 8: (7, 8)}
    made = spark.range(1).select(policy.bundles(F.array(*[F.lit(x).cast("bigint") for x in (3, 3, 5, 1, 4)]), 5).alias("n")).collect()[0].n
    assert made == 3


def test_match(tiny):
    vertices, edges, spans, pairs = tiny
    pools = find.usable(match.free_units(vertices, spans, 0, 10), pairs, F.col("status") == "up")
    order = [F.col("id").desc(), F.col("uniq_id")]
    assert sorted((r.level, r.uniq_id) for r in match.match(pools, edges, [("rack", 1), ("node", 1), ("core", 2)], order).collect()) == [(0, 2), (1, 13), (2, 106), (2, 107)]
    assert match.match(pools, edges, [("rack", 2), ("node", 1), ("core", 2)], order).count() == 0
    assert match.match(pools, edges, [("node", 3), ("core", 1)], order).where("level = 0").count() == 3
    assert match.feasible_nodes(pools, F.lit(True)).collect()[0].nodes == 3


def test_slots(spark):
    children = spark.createDataFrame([(1, "core", i, 4) for i in range(5)] + [(1, "gpu", 9, 3), (2, "core", 1, 9)], "parent long, type string, id long, amount long")
    assert {r.parent: r.slots for r in match.slots(children, {"core": 6, "gpu": 2}).collect()} == {1: 1, 2: 0}
    both = match.either([match.slots(children, {"core": 6, "gpu": 2}), match.slots(children, {"core": 9})])
    assert {r.parent: (r.variant, r.slots) for r in both.collect()} == {1: (0, 1), 2: (1, 1)}


def test_updates(tiny):
    vertices, edges, spans, pairs = tiny
    spark = spans.sparkSession
    node12 = closure.descendants(pairs, spark.createDataFrame([(12,)], "uniq_id long"))
    assert {(r.jobid, r.full) for r in update.cancelled_fully(spans, node12).collect()} == {(7, False), (8, True)}
    assert ids(update.cancel_on(spans, node12, 7)) == [100, 104] and ids(update.cancel_on(spans, node12)) == [100]
    pools, left = update.shrink(vertices, spans, pairs, spark.createDataFrame([(2,)], "uniq_id long"))
    assert pools.count() == 8 and ids(left) == [100]
    assert {(r["rank"], r.uniq_id) for r in update.rank_pools(vertices).collect()} == {(0, 10), (1, 11), (2, 12), (3, 13)}
    tagged = update.remove_property(update.set_property(vertices, F.col("uniq_id") == 10, "tag", "x"), F.col("uniq_id") == 10, "fast")
    assert tagged.where("uniq_id = 10").collect()[0].properties == {"perf_class": "10", "tag": "x"}
    new = spark.createDataFrame([(100, 9, 9, 12), (100, 9, 10, 12), (100, 7, 0, 1)], "uniq_id long, jobid long, st long, last long")
    assert [r.st for r in update.conflicts(spans, new).collect()] == [9]
    children = edges.where("src >= 10").select(F.col("src").alias("parent"), F.col("dst").alias("uniq_id"))
    assert ids(update.promoted(children, spans.select("uniq_id")), "parent") == [12]
    assert update.graft(vertices, vertices.where("uniq_id < 3").withColumn("path", F.when(F.col("uniq_id") == 1, "/new").otherwise(F.col("path")))).count() == 16
    assert ids(find.free_of(vertices, spans, pairs, 5, 6)) == [11, 13, 101, 102, 103, 104, 106, 107]


def test_lines(spark):
    rows = [(1, "q", 16, 0), (2, "q", 16, 1), (3, "q", 31, 50), (5, "r", 1, 3)]
    df = spark.createDataFrame(rows, "jobid long, queue string, priority long, t_submit long")
    assert [r.jobid for r in jobs.lines(df, 2).where("queue = 'q'").orderBy("place").collect()] == [3, 1]
    kinds = spark.createDataFrame([(True, 1), (False, 1), (False, 0)], "reserved boolean, n int").select(jobs.start_kind(F.col("reserved"), F.col("n")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["reserved", "backfill", "immediate"]


def test_readers_and_writers(spark, tiny, tmp_path):
    vertices, edges, _, _ = tiny
    writers.write_graphs(vertices, edges.withColumn("subsystem", F.lit("containment")), f"file://{tmp_path}/graph")
    read, links = readers.read_graphs(spark, f"file://{tmp_path}/graph")
    assert read.count() == 15 and links.count() == 14
    columns = ["uniq_id", "type", "name", "id", "rank", "size", "status", "path", "properties"]
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, vertices.select(columns).collect()))
    text = '{"version": 1, "execution": {"R_lite": [{"rank": "0-1", "children": {"core": "0-2", "gpu": "1"}}, {"rank": "5", "children": {"core": "7"}}], "nodelist": ["a", "b", "c"], "properties": {"fast": "0,5"}}}'
    df = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", readers.RESOURCES).alias("r")).select("r.*")
    assert readers.rank_units(df).count() == 9
    assert {(r["rank"], r.host) for r in readers.rank_hosts(df).collect()} == {(0, "a"), (1, "b"), (5, "c")}
    assert {(r["rank"], tuple(r.properties)) for r in readers.rank_properties(df).collect()} == {(0, ("fast",)), (5, ("fast",))}
    lists = writers.rank_lists(readers.rank_units(df))
    assert {(r.ranks, r.children) for r in lists.collect()} == {("0-1", "core=0-2 gpu=1"), ("5", "core=7")}
    assert readers.allowed(vertices, "node, rack").count() == 6 and readers.allowed(vertices, "").count() == 15


def test_requests(spark):
    specs = {
        1: '{"version": 1, "resources": [{"type": "node", "count": {"min": 2, "max": 8, "operator": "^", "operand": 2}, "with": [{"type": "core", "count": 4}, {"type": "core", "count": 1}]}], "attributes": {"system": {"duration": 1.2}}}',
        2: "not json",
        3: '{"version": 1, "resources": [{"type": "node"}, {"type": "rack", "count": 0}]}',
        4: None,
    }
    rows = requests.requests(spark.createDataFrame(list(specs.items()), "jobid long, jobspec string"))
    got = {(r.jobid, r.req): (r.parent, r.type, r.cmin, r.cmax, r.oper, r.operand, r.duration) for r in rows.collect()}
    assert got == {(1, "0"): (None, "node", 2, 8, "^", 2, 2), (1, "0.0"): ("0", "core", 4, 4, "+", 1, 2), (1, "0.1"): ("0", "core", 1, 1, "+", 1, 2), (3, "1"): (None, "rack", 0, 0, "+", 1, None)}
    assert {tuple(r) for r in requests.problems(rows).collect()} == {(1, "repeated type"), (3, "count")}


def test_mixed_slots(spark):
    units = spark.createDataFrame([(1, "a", 10), (1, "b", 9), (2, "a", 4), (3, "b", 7)], "parent long, type string, amount long")
    got = {r.parent: r.slots for r in match.mixed_slots(units, [{"a": 3, "b": 1}, {"b": 2}]).collect()}
    want = {p: max(i + (b - i) // 2 for i in range(min(a // 3, b) + 1)) for p, a, b in ((1, 10, 9), (2, 4, 0), (3, 0, 7))}
    assert got == want
    got = {r.parent: r.slots for r in match.mixed_slots(units, [{"a": 3, "b": 1}, {"b": 2}, {"a": 2, "b": 3}]).collect()}
    numbers = list(product(range(11), repeat=3))
    want = {p: max(i + j + k for i, j, k in numbers if 3 * i + 2 * k <= a and i + 2 * j + 3 * k <= b) for p, a, b in ((1, 10, 9), (2, 4, 0), (3, 0, 7))}
    assert got == want
    for bad in ([], [{}], [{"a": 0}]):
        with pytest.raises(ValueError):
            match.mixed_slots(units, bad)


def test_assembled_slots(spark):
    rng = random.Random(3)
    rows = [(p, t, i, rng.choice([None, 0, 1, 2, 5])) for p in range(30) for t in ("core", "gpu", "disk") for i in range(rng.randrange(9))]
    children = spark.createDataFrame(rows, "parent long, type string, id long, amount long")
    shape = {"core": 4, "gpu": 3}
    want = set()
    for p in range(30):
        filled = {}
        for t, need in shape.items():
            slots, part = [], []
            for i, n in sorted((i, n) for q, u, i, n in rows if (q, u) == (p, t) and n):
                part.append((t, i, n))
                if sum(x[2] for x in part) >= need:
                    slots.append(part)
                    part = []
            filled[t] = slots
        for k, parts in enumerate(zip(*filled.values(), strict=False)):
            want |= {(p, k, *x) for part in parts for x in part}
    made = match.assembled(children, shape)
    assert {tuple(r) for r in made.collect()} == want and len(want) > 20
    counted = match.slots(children.where("amount > 0"), shape).where("slots > 0")
    assert {tuple(r) for r in made.groupBy("parent").agg((F.max("slot") + 1).alias("slots")).collect()} == {tuple(r) for r in counted.collect()}
    assert match.assembled(children.limit(0), shape).count() == 0


def test_variants_of_exclusive_choices(tiny):
    vertices, edges, spans, pairs = tiny
    core, gpu = {"type": "core", "count": 2}, {"type": "gpu", "count": 1}
    asked = [{"type": "xor_slot", "count": 2, "with": [gpu]}, {"type": "disk", "count": 1}, {"type": "xor_slot", "count": 1, "with": [core]}]
    assert requests.variants(asked) == [[{"type": "disk", "count": 1}, {"type": "slot", "count": n, "with": [r]}] for n, r in ((2, gpu), (1, core))]
    nested = requests.variants([{"type": "rack", "count": 1, "with": [{"type": "node", "count": 1, "with": [asked[0], asked[2]]}]}])
    assert [requests.chain(v) for v in nested] == [[("rack", 1), ("node", 1), ("gpu", 2)], [("rack", 1), ("node", 1), ("core", 2)]]
    assert requests.variants([]) == [[]] and requests.chain([]) == []
    with pytest.raises(ValueError):
        requests.chain([core, gpu])
    with pytest.raises(OverflowError):
        requests.variants([{"type": "node", "with": [{"type": "xor_slot", "with": [core]}] * 11}] * 3)
    pools = match.free_units(vertices, spans, 0, 10)
    order = [F.col("id").desc(), F.col("uniq_id")]
    got = match.match_either(pools, edges, [requests.chain(v) for v in nested], order).collect()
    assert sorted((r.variant, r.level, r.uniq_id) for r in got) == [(1, 0, 2), (1, 1, 13), (1, 2, 106), (1, 2, 107)]
    assert match.match_either(pools, edges, [[("gpu", 1)]], order).count() == 0


def test_tracked_types():
    assert rollup.tracked_types("ALL:core, rack:node,rack:core,rack:node") == {"ALL": ["core"], "rack": ["node"]}
    assert rollup.tracked_types("") == {}
    for text in ("core", ":core", "rack:", "a:b:c"):
        with pytest.raises(ValueError):
            rollup.tracked_types(text)


def test_windows(spark):
    df = spark.createDataFrame([(1, 5, 1.2), (2, 90, 30.0), (3, 3, 0.0), (4, 100, 1.0), (5, 1, -1.0)], "jobid long, at long, duration double")
    got = {r.jobid: (r.until, r.state) for r in jobs.windows(df, 0, 100).collect()}
    assert got[1] == (7, "ok") and got[2] == (100, "ok") and got[3] == (100, "ok") and got[4][1] == "busy" and got[5][1] == "invalid"


def test_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert closure.closure(chain).count() == 13 * 14 // 2
    assert closure.closure(chain, 12).count() == 13 * 14 // 2
    with pytest.raises(Exception, match="deeper"):
        closure.closure(chain, 8).collect()
    with pytest.raises(ValueError, match="circle"):
        closure.closure(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), most=4)
    nested = spark.createDataFrame([(1, i, i - 1 if i else None, f"t{i}", 2) for i in range(8)], "jobid long, req int, parent int, type string, cmin long")
    assert {r.type: r.total for r in rollup.request_totals(nested).collect()} == {f"t{i}": 2 ** (i + 1) for i in range(8)}
    with pytest.raises(Exception, match="deeper"):
        rollup.request_totals(nested, levels=5).collect()


def test_rejected_requests(spark):
    deep = '{"resources": [' + '{"type": "a", "count": 1, "with": [' * 5 + "]}" * 5 + "]}"
    rows = [(1, "no"), (2, '{"resources": [{"type": "node"}]}'), (3, '{"resources": [{"count": 1}]}'), (4, deep), (5, '{"resources": [{"type": "x", "count": 1}]}'), (6, None)]
    got = {(r.jobid, r.problem) for r in requests.rejected(spark.createDataFrame(rows, "jobid long, jobspec string")).collect()}
    assert got == {(1, "no requests"), (2, "no count"), (3, "no type"), (4, "nested too deep"), (6, "no requests")}


@pytest.mark.parametrize("text", ["0-3,7", "node[08-11,3],r1", "node[0-2]", "5", "a,b-c"])
def test_within_equals_members(spark, text):
    names = [f"{p}{n}" for p in ("", "node", "r") for n in ("0", "1", "2", "3", "7", "8", "08", "09", "10", "11", "011", "5", "x", "")] + ["a", "b", "b-c"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name for r in rows.where(idset.within(F.col("name"), text)).collect()}
    assert got == set(idset.members(text)) & set(names)


def test_node_exclusive(tiny):
    vertices, _, spans, pairs = tiny
    chosen = spans.sparkSession.createDataFrame([(100,), (106,)], "uniq_id long")
    got = policy.whole_nodes(chosen, vertices, pairs)
    assert sorted(tuple(r) for r in got.collect()) == [(10, 10), (10, 100), (10, 101), (13, 13), (13, 106), (13, 107)]
    assert policy.POLICIES["first"].node_centric and policy.POLICIES["firstnodex"].node_exclusive


@pytest.mark.parametrize("name, taken", [("high", [(3, 5), (2, 1)]), ("low", [(1, 3), (2, 3)]), ("first", [(3, 5), (2, 1)]), ("locality", [(1, 3), (2, 3)]), ("variation", [(2, 4), (1, 2)])])
def test_policies_choose(spark, name, taken):
    rows = [("a", i, i, i, n, 0, 0, {"perf_class": c}) for i, n, c in ((1, 3, "5"), (2, 4, "1"), (3, 5, "x"))]
    df = spark.createDataFrame(rows, "g string, id long, uniq_id long, k long, amount long, node_id long, node long, properties map<string,string>")
    got = policy.choose(df, F.lit(6), ["g"], name).collect()
    assert {(r.id, r.taken) for r in got} == set(taken)


def test_conflicts_equal_pairs(spark):
    import random

    rng = random.Random(3)
    spans = [(p, rng.randrange(6), s := rng.randrange(30), s + rng.randint(0, 5), 1) for p in range(4) for _ in range(8)]
    new = [(p, rng.randrange(8), s := rng.randrange(30), s + rng.randint(1, 5), 1) for p in range(5) for _ in range(8)]
    schema = "uniq_id long, jobid long, st long, last long, planned long"
    want = sorted(n for n in new if any(p == n[0] and j != n[1] and s < n[3] and e > n[2] for p, j, s, e, _ in spans))
    held, asked = spark.createDataFrame(spans, schema), spark.createDataFrame(new, schema)
    assert sorted(tuple(r) for r in update.conflicts(held, asked).collect()) == want
    kept, refused = update.apply(held, asked)
    assert kept.count() == len(spans) + sum(n[1] not in {w[1] for w in want} for n in new) and {r.jobid for r in refused.collect()} == {w[1] for w in want}


def test_conflicts_of_empty_spans(spark):
    schema = "uniq_id long, jobid long, st long, last long, planned long"
    held = spark.createDataFrame([(1, 1, 5, 5, 1), (1, 2, 3, 8, 1), (2, 1, 0, 9, 1), (2, 1, 1, 7, 1), (2, 2, 2, 4, 1), (2, None, 0, 50, 1)], schema)
    asked = spark.createDataFrame([(1, 3, 5, 5, 1), (1, 2, 6, 7, 1), (2, 1, 3, 9, 1), (2, 1, 3, 9, 1), (2, 1, 4, 9, 1), (2, None, 0, 9, 1), (2, 2, 8, 9, 1)], schema)
    want = [(1, 3, 5, 5, 1), (2, 1, 3, 9, 1), (2, 1, 3, 9, 1), (2, 2, 8, 9, 1)]
    assert sorted(tuple(r) for r in update.conflicts(held, asked).collect()) == want


def test_associated_lists(spark, monkeypatch):
    monkeypatch.setattr(readers, "IDS", 16)
    monkeypatch.setattr(readers, "TURN", 3)
    a = spark.createDataFrame([(n, f"/c/{'xyz'[n % 3]}/s{n}") for n in range(30)], "uniq_id long, path string")
    b = spark.createDataFrame([(n, f"/c/{'xyw'[n % 3]}/t{n}") for n in range(100, 150)], "uniq_id long, path string")
    above = counts.path_above(F.col("path"), 1)
    want = sorted((s, t) for s in range(30) for t in range(100, 150) if s % 3 == t % 3 and s % 3 < 2)
    got = readers.associate(a, b, above)
    assert sorted(tuple(r) for r in got.collect()) == want
    # What is joined and dealt are lists, not pairs.
    assert got._jdf.queryExecution().optimizedPlan().toString().index("Generate") < got._jdf.queryExecution().optimizedPlan().toString().index("Join")
