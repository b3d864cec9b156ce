import math
import random

import pytest
from pyspark.sql import functions as F

from poolframe.llm import topk_search


@pytest.mark.parametrize("sizes", [{}, {"QUERIES": 2, "CANDIDATES": 7}, {"QUERIES": 2, "CANDIDATES": 5, "BLOCKS": 1, "ROWS": 2, "HELD": 1}])
def test_equals_all_products(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk_search, name, value)
    rng = random.Random(6)
    vectors = {i: [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(6)] for i in range(1, 80)}
    vectors |= {i: [0.5] * 6 for i in range(80, 100)} | {100: [], 101: [1.0, 2.0]}
    odd = [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [9.0] * 6)]
    docs = spark.createDataFrame([(k, v, 1) for k, v in [*vectors.items(), *odd]], "vec_id long, embedding array<float>, rank int").repartition(4)
    exact = {r.vec_id: r.w for r in docs.where("vec_id < 200").select("vec_id", topk_search.weights(F.col("embedding")).alias("w")).collect()}
    assert exact[101] == [256, 512]
    assert all(exact[k] == [math.floor(256 * float(x)) for x in r.embedding] for k, r in ((r.vec_id, r) for r in docs.where("vec_id < 200").collect()))
    want = set()
    for q in (k for k in exact if k % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(exact[q], w, strict=False)), k) for k, w in exact.items() if k != q)
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:5])}
    got = topk_search.search(docs, F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert topk_search.search(docs.limit(0), F.lit(True)).count() == 0
    assert topk_search.search(docs.where("vec_id < 4"), F.lit(True)).count() == 6
