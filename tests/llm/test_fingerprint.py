import hashlib
import random

import numpy as np

from poolframe.llm import fingerprint


def test_edits_and_likeness(spark):
    rng = random.Random(4)
    words = [f"wörd{i}" for i in range(3000)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([3, 40, 300]))) for i in range(60)} | {100: "", 101: None, 102: " \n", 103: "x" * 100_000, 104: "x" * 100_000}
    docs = spark.createDataFrame([(k, v, "f") for k, v in texts.items()] + [(None, "without a key", "f")], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    order = sorted(texts, reverse=True) + [None]
    full = {k: v or "" for k, v in texts.items()} | {None: "without a key"}
    assert len(got) == len(order)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprint.edited(full[k], full[after])
        assert got[k].n_chars == len(full[k]) and got[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for estimate, other in ((got[k].near_edited, changed), (got[k].near_next, full[after])):
            a, b = shingles(full[k]), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(estimate - true) < 0.17, (k, estimate, true)
    assert got[103].fingerprint == got[104].fingerprint and got[100].fingerprint == ""


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    (row,) = fingerprint.with_edits(docs).collect()
    assert row.near_next == 1.0
    assert fingerprint.with_edits(docs.limit(0)).count() == 0


def test_empty_bins_borrow():
    data = b"just one two three four"
    prints, some = fingerprint.fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    again, _ = fingerprint.fingerprints(np.frombuffer(data + b" ", np.uint8), np.array([0, len(data) + 1]))
    assert some.all() and (prints == again).all()
    other, _ = fingerprint.fingerprints(np.frombuffer(b"other words", np.uint8), np.array([0, 11]))
    assert fingerprint.likeness(prints, other, some, some)[0] < 0.1


def test_rows_of_one_key(spark):
    rows = [(7, f"text number {i % 40} of one key") for i in range(200)] + [(8, "the first"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first, again = (sorted(tuple(r) for r in fingerprint.with_edits(d).collect()) for d in (docs, docs.repartition(3).coalesce(2)))
    assert first == again
    assert len(first) == 202
