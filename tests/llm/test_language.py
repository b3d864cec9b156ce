import random

import numpy as np
from pyspark.sql import functions as F

from poolframe.llm import language


def test_presence_is_that_of_ngrams():
    texts = ["Abc abc", "", "ü", "ab"]
    parts = [t.encode() for t in texts]
    data, starts = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = language.presence(data, starts)
    for row, p in zip(got, parts, strict=True):
        p = p.lower() if p.isascii() else p
        grams = {p[i : i + n] for n in language.LENGTHS for i in range(len(p) - n + 1)}
        assert len(grams) - 2 <= row.sum() <= len(grams)
    alone = language.presence(data[starts[3] :], np.array([0, 2]))
    assert (alone[0] == got[3]).all()


def test_learns_languages(spark):
    rng = random.Random(3)
    stems = {"aa": ["lo", "mi", "ta"], "bb": ["sch", "ung", "ich"], "cc": ["ция", "ост", "пре"]}
    text = lambda x: " ".join("".join(rng.choices(stems[x], k=3)) for _ in range(30))
    rows = [(i, text(x), x, "s") for i in range(240) for x in [list(stems)[i % 3]]] + [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, "", "bb", "s"), (903, text("cc"), None, "s"), (None, text("bb"), "bb", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    fold = language.remainder(F.col("doc_id"), 3) == 1
    model = language.train(docs, ~fold)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:240])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "cc", "bb"]
    assert got[900].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.train(docs, F.lit(False))).collect()} == {"und"}


def test_long_texts_keep_their_language(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shares = {x: [rng.random() ** 3 + 0.02 for _ in letters] for x in ("aa", "bb", "cc")}

    def text(x, n):
        # All letters are in all languages, so a long text of any has nearly all n-grams.
        body = rng.choices(letters, shares[x], k=n)
        body[5::6] = " " * len(body[5::6])
        return "".join(body)

    rows = [(i, text(x, 300), x) for i in range(240) for x in [list(shares)[i % 3]]]
    rows += [(1000 + i, text(x, 1_000_000), x) for i, x in enumerate(shares)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(docs, F.col("doc_id") < 1000)
    got = {r.doc_id: r for r in language.predict(docs.where("doc_id >= 1000"), model).collect()}
    assert [got[1000 + i].lang_pred for i in range(3)] == ["aa", "bb", "cc"]


def test_windows_hold_all_ngrams():
    text = bytes(random.Random(2).choices(range(97, 105), k=10_001))
    data = np.frombuffer(text, np.uint8)
    low, high, own = language.windows(np.array([0, 0, 10_001]))
    assert own.tolist() == [0, 1, 1, 1] and low[1] == 0 and high[-1] == 10_001 and (high - low <= language.WINDOW + 3).all()
    assert (language.window_presence(data, low, high).any(0) == language.presence(data, np.array([0, 10_001]))[0]).all()


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda rows, labels: seen.append(labels))
    rows = [(7, "one text", "aa")] * 300 + [(i, f"some text {i}", "bb") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    language.train(docs, F.lit(True), per_language=50, most=40)
    assert seen == [["aa"] + ["bb"] * 20]


def test_predictions_equal_the_formula(spark):
    """Scores from sets of n-grams by plain Python; two n-grams of a text fall on one place at most."""
    rng = random.Random(4)
    texts = {i: "".join(rng.choices("abcde" if i % 2 else "vwxyz", k=12)) for i in range(12)}
    docs = spark.createDataFrame([(i, t, "one" if i % 2 else "two") for i, t in texts.items()], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    grams = lambda t: {t[i : i + n] for n in language.LENGTHS for i in range(len(t) - n + 1)}
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    marks = [set(np.flatnonzero(m)) for m in model.landmarks]
    for i, t in texts.items():
        data = np.frombuffer(t.encode(), np.uint8)
        own = set(np.flatnonzero(language.presence(data, np.array([0, len(data)]))[0]))
        assert len(grams(t)) - 1 <= len(own) <= len(grams(t))
        kernel = np.array([len(own & m) / (len(own) * len(m)) ** 0.5 for m in marks])
        scores = kernel @ model.weights
        assert found[i].lang_pred == model.languages[int(scores.argmax())] == ("one" if i % 2 else "two")
        assert abs(found[i].score - min(max(scores.max(), 0), 1)) < 1e-4
