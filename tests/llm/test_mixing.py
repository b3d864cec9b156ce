import random
from collections import defaultdict

import pytest

from poolframe.llm import mixing


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing out again what is above a limit, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        over = {s for s, w in rest.items() if left * w / sum(rest.values()) > most * sizes[s]}
        if not over:
            return full | {s: left * w / sum(rest.values()) for s, w in rest.items()}
        for s in over:
            full[s] = most * sizes[s]
            left -= most * sizes[s]


@pytest.mark.parametrize("salted", [False, True])
def test_mix(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = random.Random(9)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(1, 60))), rng.choice(["a", "a", "a", "b", "c", "é", None]), 1) for i in range(1500)]
    rows += [(5000, None, "zero", 1), (5001, " \t", "zero", 1), (None, "no key", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s, want in shares(sizes).items():
        assert abs(target[s] - want) < 1e-6 * max(want, 1), s
        assert abs(taken[s] - want) <= 60, s
    assert len(got) == len(rows)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(docs.limit(0)).count() == 0
