import random
import re

import numpy as np
import pyarrow as pa
import pytest

from poolframe.llm import components, ngram_join


def brute(texts):
    """Components by all pairs of the sets of shingles."""
    sets = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    least = {k: k for k in sets}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(words, k=40))
    out = {}
    for k in range(n):
        kind = rng.random()
        if k and kind < 0.5:
            base = out[rng.randrange(k)].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(base) + 1)
                base[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
            out[k] = " ".join(base)
        elif kind < 0.6:
            out[k] = passage + " " + " ".join(rng.choices(words, k=rng.randrange(12)))
        else:
            out[k] = " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 9, 30, 80, 200])))
    return out


@pytest.mark.parametrize("settings", [{}, {"RUN": 2, "BLOCK": 300}])
def test_equals_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = corpus(3 + len(settings)) | {1000: None, 1001: "", 1002: " \n", 1003: "One two", 1004: "one\ttwo", 1005: "ÀB c", 1006: "àb c"}
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, set_id string, family int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_groups(docs).collect()}
    assert got == brute(texts)


def test_common_ngrams_lead_to_one_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_ranks", lambda sketch: np.where(sketch > 5, 3, 0).astype(np.int8))
    texts = corpus(11)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_groups(docs).collect()} == brute(texts)


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "quite other words are here now"), (None, "lonely text")], "doc_id long, text string")
    rows = ngram_join.join_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (5, 5), (5, 5)]
    assert ngram_join.join_groups(docs.limit(0)).count() == 0
    assert sorted(r.text for r in ngram_join.deduplicate(docs).collect()) == sorted(r.text for r in docs.collect())


def test_deduplicate(spark):
    texts = corpus(5, 120)
    docs = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, gone long")
    kept = {r.doc_id for r in ngram_join.deduplicate(docs).collect()}
    assert kept == {k for k, (n, c) in brute(texts).items() if c == k or not n}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(100, 7), (None, 3), (5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[40] == 37 and got[100] == 1 and got[1] == 1
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_go_to_blocks_in_bounded_batches(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1004))
    data = np.frombuffer(text.encode(), np.uint8)
    sets, begin = ngram_join.distinct_shingles(data, np.array([0, len(data)]))
    name = int(ngram_join.set_ids(sets, begin)[0])
    row = pa.record_batch([pa.array([text]), pa.array([name]), pa.array([1]), pa.array([3]), pa.array([0]), pa.array([500])], names=["text", "set_id", "family", "own", "low", "high"])
    monkeypatch.setattr(ngram_join, "SHIP_BYTES", 50_000)
    for apart in (False, True):
        made = list(ngram_join._shipped(iter([row]), 5, apart))
        assert len(sets) == 1000 and sum(b.num_rows for b in made) == 500
        assert max(sum(len(x.as_py()) for x in b.column(5)) for b in made) < 50_000 + 8_000 + 1
        want = [(min(3, j), max(3, j), 3) if apart else (j, j, j) for j in range(500)]
        assert [tuple(r[k] for k in ("one", "two", "own")) for b in made for r in b.to_pylist()] == want


def test_copies_grow_with_a_family_not_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 1000)
    members = spark.range(4000).selectExpr("id AS doc_id", "xxhash64(id) AS set_id", "50L AS n", "7L AS family")
    placed = ngram_join._placed(members).cache()
    assert placed.count() == 4000 and placed.agg({"blocks": "max"}).first()[0] == 200
    assert placed.selectExpr("sum(high - low)").first()[0] < 3 * 4000
    label = lambda *own: members.selectExpr("set_id AS node", "CASE " + " ".join(f"WHEN doc_id = {k} THEN {k}" for k in own) + " ELSE -1L END AS label")
    assert ngram_join._placed_again(placed, label(-5)).isEmpty()
    again = ngram_join._placed_again(placed, label(1, 2, 3))
    assert again.count() == 4000 and again.selectExpr("sum(high - low)").first()[0] < 2 * 4000
    two = ngram_join._placed(spark.createDataFrame([(1, 11, 1 << 25, 7), (2, 12, 1 << 25, 7)], "doc_id long, set_id long, n long, family long")).collect()
    assert [(r.blocks, r.high - r.low) for r in two] == [(1, 1), (1, 1)]


def test_many_blocks_and_classes_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 400)
    monkeypatch.setattr(ngram_join, "STANDARDS", 1)
    monkeypatch.setattr(ngram_join, "_ranks", lambda sketch: np.where(sketch > 3, 3, 0).astype(np.int8))
    texts = corpus(23, 300)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_groups(docs).collect()} == brute(texts)
