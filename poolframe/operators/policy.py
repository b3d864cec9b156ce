"""Scores of candidates, and the best of them for a need."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Policy:
    """How candidates are chosen: by high or low ids, node by node, whole nodes, the first that will do."""

    descending: bool = True
    node_centric: bool = False
    node_exclusive: bool = False
    stop_on_first: bool = False


POLICIES = {
    "high": Policy(),
    "low": Policy(descending=False),
    "hinode": Policy(node_centric=True),
    "lonode": Policy(descending=False, node_centric=True),
    "hinodex": Policy(node_centric=True, node_exclusive=True),
    "lonodex": Policy(descending=False, node_centric=True, node_exclusive=True),
    "first": Policy(node_centric=True, stop_on_first=True),
    "firstnodex": Policy(node_centric=True, node_exclusive=True, stop_on_first=True),
}
#: Policies that order by neighbourhood or by a class of performance, not by ids.
OTHERS = ("locality", "variation")


def policy(text: str) -> Policy:
    """A policy by name, or from settings such as "policy=low node_centric=true"."""
    if text in POLICIES:
        return POLICIES[text]
    given = dict(part.partition("=")[::2] for part in text.split())
    flags = {"node_centric": "node_centric", "node_exclusive": "node_exclusive", "stop_on_1_matches": "stop_on_first"}
    if given.get("policy", "high") not in ("high", "low") or set(given) - {"policy", *flags} or any(given[k] not in ("true", "false") for k in flags if k in given):
        raise ValueError(f"invalid policy: {text!r}")
    return Policy(descending=given.get("policy", "high") == "high", **{name: given.get(k) == "true" for k, name in flags.items()})


def id_score(id: Column, node_id: Column | None = None, node: Column | None = None) -> Column:
    """1 + id + 1, and for what is below a node that node's factor."""
    score = id + 2
    if node_id is None or node is None:
        return score
    return score + F.coalesce((node_id + 2) * 10_000 + F.abs(node % 10_000 - 1), F.lit(0))


def variation_score(properties: Column) -> Column:
    """1 + the class of performance; classes that are missing or not in 0 to 9999 are the last."""
    digits = F.regexp_extract(properties["perf_class"], r"^\s*(\d+)", 1)
    value = F.try_to_number(digits, F.lit("999999999")).cast("bigint")
    return 1 + F.coalesce(F.when(value.between(0, 9999), value), F.lit(9999)).cast("bigint")


def best(candidates: DataFrame, need: Column, by: Sequence[str], order: Sequence[Column], amount: str = "amount") -> DataFrame:
    """Of each group the first candidates whose amounts reach `need`, with `taken`: the last gives what is left.

    `order` must be total. Groups with less than they need give nothing. Amounts are summed
    up along the order, so a group is sorted once and nothing is looped over.
    """
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    summed = candidates.withColumns({"upto": F.sum(amount).over(so_far), "of_all": F.sum(amount).over(whole), "wanted": need})
    kept = summed.where((F.col("of_all") >= F.col("wanted")) & (F.col("upto") - F.col(amount) < F.col("wanted")))
    return kept.withColumn("taken", F.least(F.col(amount), F.col("wanted") - (F.col("upto") - F.col(amount)))).drop("upto", "of_all", "wanted")


def order(chosen: Policy) -> list[Column]:
    """A total order of candidates (id, uniq_id; node_id and node of the node above, if it counts) by score."""
    score = id_score(F.col("id"), F.col("node_id"), F.col("node")) if chosen.node_centric else id_score(F.col("id"))
    return [score.desc() if chosen.descending else score.asc(), F.col("uniq_id").asc()]


def choose(candidates: DataFrame, need: Column, by: Sequence[str], name: str, amount: str = "amount") -> DataFrame:
    """What a policy, by name or settings, takes of each group's candidates to reach `need`, with `taken`.

    Policies that stop on the first match take candidates in the order in which they would be met, those with
    most free first; the others in order of score. Of node-exclusive ones `whole_nodes` tells what goes with the choice.
    """
    if name == "locality":
        return best(runs(candidates, by), need, by, [F.col("high").desc(), F.col("id"), F.col("uniq_id")], amount)
    if name == "variation":
        return best(candidates, need, by, [variation_score(F.col("properties")), F.col("uniq_id")], amount)
    chosen = policy(name)
    met = [F.col(amount).desc(), F.col("uniq_id").desc()] if chosen.stop_on_first else order(chosen)
    return best(candidates, need, by, met, amount)


def whole_nodes(chosen: DataFrame, vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, uniq_id: nodes on or above the chosen pools (uniq_id), each with all below it and itself: it is taken whole."""
    nodes = vertices.where("type = 'node'").select(F.col("uniq_id").alias("anc"))
    used = pairs.join(nodes, "anc", "left_semi").join(chosen.select(F.col("uniq_id").alias("desc")), "desc", "left_semi").select("anc").distinct()
    return pairs.join(used, "anc", "left_semi").select(F.col("anc").alias("node"), F.col("desc").alias("uniq_id"))


def score_sums(chosen: DataFrame, by: Sequence[str], score: Column) -> DataFrame:
    """by, pools, units, score: how many pools a match took of each group (taken), and the sum of their scores."""
    return chosen.groupBy(*by).agg(F.count("*").alias("pools"), F.sum("taken").alias("units"), F.sum(score).alias("score"))


def every(candidates: DataFrame, by: Sequence[str], order: Sequence[Column], score: Column) -> DataFrame:
    """All candidates with their place in each group, and `upto`: the sum of scores to that place."""
    turn = Window.partitionBy(*by).orderBy(*order)
    return candidates.withColumns({"place": F.row_number().over(turn), "upto": F.sum(score).over(turn.rowsBetween(Window.unboundedPreceding, 0))})


def top(candidates: DataFrame, k: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first k candidates of each group; tasks drop the others before they are shuffled."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def runs(candidates: DataFrame, by: Sequence[str], id: str = "id") -> DataFrame:
    """Candidates with low and high of the run of neighbouring ids that they are in."""
    turn = Window.partitionBy(*by).orderBy(id)
    island = candidates.withColumn("island", F.col(id) - F.dense_rank().over(turn))
    run = Window.partitionBy(*by, "island")
    return island.withColumns({"low": F.min(id).over(run), "high": F.max(id).over(run)}).drop("island")


def bundles(amounts: Column, per_bundle: Column | int) -> Column:
    """How many bundles an array of amounts makes, each of whole amounts in turn; what is over in one is lost."""
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("made"))
    per = F.lit(per_bundle) if isinstance(per_bundle, int) else per_bundle

    def add(state: Column, amount: Column) -> Column:
        held = state["held"] + amount
        return F.struct(F.when(held >= per, 0).otherwise(held).cast("bigint").alias("held"), (state["made"] + (held >= per).cast("bigint")).alias("made"))

    return F.aggregate(amounts, start, add)["made"]
