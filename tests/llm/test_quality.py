import random

import numpy as np
from pyspark.sql import functions as F

from poolframe.llm import quality


def flat(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def test_lines():
    codes, length, begin = quality.lines(*flat(["one two\nTHREE!! FOUR!!", "", "a\n", "same same same\nsame same same"]))
    assert length.tolist() == [7, 14, 0, 1, 0, 14, 14]
    assert begin.tolist() == [0, 2, 3, 5, 7]
    kinds = list(quality.EDGES)
    at = lambda line, kind: codes[line, kinds.index(kind)] - quality.OFFSETS[kinds.index(kind)]
    assert at(1, "upper_of_letters") == 6 and at(0, "upper_of_letters") == 0
    assert at(1, "words_ending_in_symbols") == 5 and at(5, "words_like_the_last") == 5
    assert at(6, "line_seen_before") == 1 and at(5, "line_seen_before") == 0


def brute_marginals(scores, steps):
    n, total, out = len(scores), 0.0, np.zeros(len(scores))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        out += w * np.array(y)
    return out / total, np.log(total)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 7, 2, 4]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    scores, steps = rng.normal(size=begin[-1]), rng.normal(size=(2, 2))
    got, pair, log = quality.marginals(scores, begin, steps)
    want = [brute_marginals(scores[a:b], steps) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert np.allclose(got, np.concatenate([w for w, _ in want])) and np.isclose(log, sum(t for _, t in want))
    assert np.allclose(pair[1:5].sum((1, 2))[1:4], 1)


def test_learns_and_scores(spark):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(rng.choice(["apple", "river", "stone", "walk"]) for _ in range(8)) + "." for _ in range(rng.randint(1, 6)))
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY", "NOW", "WIN"]) + "!!" for _ in range(8)) for _ in range(rng.randint(1, 6)))
    rows = [(i, bad() if i % 4 == 0 else good(), "x", 0.5) for i in range(200)] + [(900, None, "x", 0.5), (901, "", "x", 0.5), (None, good(), "x", 0.5), (902, "z" * 200_000, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(150)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels, ~quality.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in quality.score(docs, field).collect()}
    assert all(got[i].predicted == int(i % 4 != 0) for i in range(200))
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got.values())
    assert quality.score(docs.limit(0), field).count() == 0
    empty = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_held_out(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert [r.h for r in rows if r.doc_id is None] == [False]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    codes, _, begin = quality.lines(*flat(["one two\nTHREE!! 4\n\nfive", "", "a b c\nd e.\nF", "same\nsame"]))
    label = rng.integers(0, 2, len(codes)).astype(float)
    value = rng.normal(size=3 * quality.FEATURES + 5) / 2

    def likelihood(value):
        field = quality.unflat(value)
        scores, total = field.scores(codes, begin), 0.0
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            y = label[a:b].astype(int)
            total += (scores[a:b] * y).sum() + sum(field.steps[p, q] for p, q in zip(y, y[1:], strict=False)) - brute_marginals(scores[a:b], field.steps)[1]
        return total

    got = quality.gradient(quality.unflat(value), codes, begin, label)
    for i in [*range(0, 3 * quality.FEATURES, 5), *range(3 * quality.FEATURES, len(value))]:
        step = np.zeros(len(value))
        step[i] = 1e-5
        assert np.isclose(got[i], (likelihood(value + step) - likelihood(value - step)) / 2e-5, atol=1e-5)


def test_scores_equal_enumeration(spark):
    rng = np.random.default_rng(6)
    field = quality.unflat(rng.normal(size=3 * quality.FEATURES + 5) / 3)
    texts = ["one two\nTHREE!! 4\n\nfive", "", "a b c\nd e.\nF", None, "x"]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()}
    for i, text in enumerate(texts):
        codes, length, begin = quality.lines(*flat([text or ""]))
        weight = length + 1
        assert np.isclose(got[i], (brute_marginals(field.scores(codes, begin), field.steps)[0] * weight).sum() / weight.sum())


def test_sample_takes_whole_documents_and_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda codes, begin, good: seen.append((np.diff(begin).tolist(), good.tolist())))
    rows = [(i, "word\n" * (i % 7)) for i in range(60)] + [(5, "word\n" * 3)] * 50 + [(100, "w\n" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 100]], "doc_id long, quality int")
    quality.train(docs, labels, F.lit(True), per_label=20, most_lines=60, longest=40)
    quality.train(docs.orderBy("text"), labels.repartition(5), F.lit(True), per_label=20, most_lines=60, longest=40)
    lengths, good = seen[0]
    assert seen[0] == seen[1] and max(lengths) <= 7 and 20 < len(good) <= 40
    for g in (0, 1):
        assert sum(n for n, x in zip(lengths, good, strict=True) if x == g) <= 60
