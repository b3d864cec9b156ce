import pytest
from pyspark.sql import functions as F

from poolframe.operators import jobs, match, policy, rollup
from poolframe.sources import formats, readers, recipes

RECIPE = """<?xml version="1.0"?>
<graphml>
  <graph id="small" edgedefault="directed">
    <node id="cluster"><data key="root">1</data><data key="type">cluster</data><data key="basename">box</data></node>
    <node id="rack"><data key="type">rack</data></node>
    <node id="node"><data key="type">node</data></node>
    <node id="memory"><data key="type">memory</data><data key="size">8</data></node>
    <node id="power"><data key="root">1</data><data key="type">power</data><data key="subsystem">power</data></node>
    <edge id="a" source="cluster" target="rack"><data key="multi_scale">2</data></edge>
    <edge id="b" source="rack" target="node"><data key="multi_scale">3</data><data key="id_scope">1</data><data key="id_stride">10</data></edge>
    <edge id="c" source="node" target="memory"><data key="multi_scale">2</data><data key="id_start">5</data></edge>
    <edge id="d" source="power" target="node"><data key="e_subsystem">power</data><data key="gen_method">ASSOCIATE_IN</data></edge>
    {more}
  </graph>
</graphml>
"""


def test_recipe(spark, tmp_path):
    path = tmp_path / "r.graphml"
    path.write_text(RECIPE.format(more=""))
    rows = formats.reader("grug")(spark, str(path)).collect()
    assert len(rows) == 1 + 2 + 6 + 12
    assert sorted(r.path for r in rows if r.type == "rack") == ["/box0/rack0", "/box0/rack1"]
    # Ids of nodes count on over both racks, in steps of ten; those of memory start again in each node.
    assert sorted(r.id for r in rows if r.type == "node") == [0, 10, 20, 30, 40, 50]
    assert {(r.id, r.size) for r in rows if r.type == "memory"} == {(5, 8), (6, 8)}
    assert len({r.path for r in rows}) == len(rows)


def test_recipe_in_a_circle(spark, tmp_path):
    path = tmp_path / "r.graphml"
    path.write_text(RECIPE.format(more='<edge id="e" source="memory" target="rack"/>'))
    with pytest.raises(ValueError, match="circle"):
        recipes.expand(spark, *recipes.recipe(spark, str(path)))


def test_recipe_without_root(spark, tmp_path):
    path = tmp_path / "r.graphml"
    path.write_text(RECIPE.format(more=""))
    kinds, rules = recipes.recipe(spark, str(path))
    with pytest.raises(ValueError, match="no root"):
        recipes.expand(spark, kinds, rules, "cooling")


def test_formats(spark):
    with pytest.raises(ValueError, match="unknown format"):
        formats.reader("yaml")
    with pytest.raises(ValueError, match="unknown writer"):
        formats.reader_of("other:jgf")
    assert formats.reader_of("fluxion:jgf") is formats.reader("jgf")
    assert formats.writer("no such") is formats.writer("simple")
    pools = spark.createDataFrame([("node", "node1", 1, 1, 0, "/c0/node1", 4, True)], "type string, name string, id bigint, uniq_id bigint, rank bigint, path string, units bigint, exclusive boolean")
    assert formats.writer("pretty_simple")(pools).head().line == "   node1[4:exclusive]"


def test_able_ties_and_empty(spark):
    amounts = spark.createDataFrame([(4,), (4,), (2,)], "amount bigint")
    needs = spark.createDataFrame([(0,), (2,), (3,), (4,), (4,), (5,)], "need bigint")
    assert {tuple(r) for r in match.able(amounts, needs).collect()} == {(0, 3), (2, 3), (3, 2), (4, 2), (5, 0)}
    assert {r.able for r in match.able(amounts.where("false"), needs).collect()} == {0}


def test_outcomes(spark):
    now, ever = (spark.createDataFrame([(n,) for n in ns], "amount bigint") for ns in ((3, 0, 1), (3, 3, 2)))
    asked = spark.createDataFrame([(1, 1, 3), (2, 2, 3), (3, 3, 3), (4, 2, 1), (4, 2, 1)], "jobid bigint, count bigint, need bigint")
    assert sorted(map(tuple, match.outcomes(asked, now, ever).collect())) == [(1, "matched"), (2, "busy"), (3, "impossible"), (4, "matched"), (4, "matched")]


def test_pruned_order_of_reasons(spark):
    # 1 above 2, 3 and 4; 2 above 5. 2 is down and unwanted: its status comes first, and 5 is never met.
    pools = spark.createDataFrame([(1, "rack", "up", 1), (2, "node", "down", 0), (3, "node", "up", 0), (4, "node", "up", 1), (5, "core", "up", 1)], "uniq_id bigint, type string, status string, free bigint").selectExpr("*", "free AS size")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 5, 1), (1, 5, 2), *[(n, n, 0) for n in range(1, 6)]], "anc bigint, desc bigint, depth int")
    busy = spark.createDataFrame([(4,)], "uniq_id bigint")

    def reasons(busy, wanted, keep="uniq_id != 2"):
        return dict(map(tuple, match.pruned(pools, pairs, F.expr(keep), 1, busy, wanted).collect()))

    assert reasons(busy.where("false"), {"core": 1}) == {1: None, 2: "status", 3: "availability", 4: None, 5: "above"}
    assert reasons(busy, {"core": 1}) == {1: "exclusivity", 2: "above", 3: "above", 4: "above", 5: "above"}
    assert reasons(busy.where("false"), {"core": 2})[1] == "subtree"
    assert reasons(busy.where("false"), {"core": 1}, "null")[1] == "constraint"


def test_supported(spark):
    pools = spark.createDataFrame([(1,), (2,), (3,), (4,)], "uniq_id bigint")
    pairs = spark.createDataFrame([(10, 1, 1), (11, 2, 1), (12, 3, 1)], "anc bigint, desc bigint, depth int")
    amounts = spark.createDataFrame([(10, 5), (11, 1)], "uniq_id bigint, amount bigint")
    assert sorted(r.uniq_id for r in match.supported(pools, pairs, amounts, 2).collect()) == [1, 4]


def test_least_wanted():
    assert rollup.least_wanted([{"core": 4, "gpu": 1}, {"core": 2}]) == {"core": 2}


def test_same_units(spark):
    rows = [("a", 0, "core", 1), ("a", 0, "core", 2), ("b", 1, "core", 1)]
    a = spark.createDataFrame(rows, "k string, rank bigint, type string, id bigint")
    b = spark.createDataFrame([*rows[:1], *rows, ("c", 0, "core", 0)], a.schema)
    assert dict(map(tuple, readers.same_units(a, b, ["k"]).collect())) == {"a": True, "b": True, "c": False}


def test_every_and_sums(spark):
    rows = spark.createDataFrame([("n", 1, 2), ("n", 2, 2), ("m", 3, 1)], "parent string, id bigint, taken bigint")
    placed = policy.every(rows, ["parent"], [F.col("id").desc()], F.col("id")).collect()
    assert {(r.id, r.place, r.upto) for r in placed} == {(2, 1, 2), (1, 2, 3), (3, 1, 3)}
    assert {tuple(r) for r in policy.score_sums(rows, ["parent"], F.col("id")).collect()} == {("n", 2, 4, 3), ("m", 1, 1, 3)}


def test_job_info(spark):
    spans = spark.createDataFrame([(1, 7, 0, 5), (2, 7, 0, 9), (1, 8, 6, 9), (1, 9, 0, 2)], "uniq_id bigint, jobid bigint, st bigint, last bigint")
    assert {tuple(r) for r in jobs.info(spans, 5).collect()} == {(7, "allocated", 0, 9, 2), (8, "reserved", 6, 9, 1), (9, "done", 0, 2, 1)}
