import collections
import os
import random

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        counts.append(after.count())
        if name != "packing":
            assert after.columns == columns and after.dtypes == docs.dtypes
            before = after
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert set(r.doc_id for r in after.select("doc_id").distinct().collect()) == set(r.doc_id for r in before.select("doc_id").distinct().collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_no_documents(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert stage(spark, docs, DATA).count() == 0


def odd_documents(spark):
    """Documents with nulls, empty and long texts, repeats, and columns with the names that operators add."""
    rng = random.Random(5)
    words = lambda k: " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(k))
    passage, twin = words(90), words(120)
    texts = {i: words(rng.randint(5, 80)) + "." for i in range(40)} | {50: None, 51: "", 52: " \n", 53: words(180_000), 60: twin, 61: twin + " end", 62: twin}
    texts |= {i: words(40) + " " + passage + " " + words(40) for i in (70, 71, 72)}
    rows = [(k, t, "s" if k % 3 else None, len(t or ""), -1.0, "p", -3, "r", -7, "c", "z", "t", "e", "h") for k, t in texts.items()]
    rows += [rows[0], rows[0], (None, words(30), "s", 1, -1.0, "p", -3, "r", -7, "c", "z", "t", "e", "h"), (None, None, None, None, -1.0, "p", -3, "r", -7, "c", "z", "t", "e", "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, Score double, predicted string, n_removed int, removed string, size int, copy string, copies string, target string, gone string, draw string").repartition(3), texts


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs, texts = odd_documents(spark)
    plain = lambda df: sorted(map(str, df.drop("text", "n_chars").distinct().collect()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert set(plain(after)) <= set(plain(docs)), name
        assert {r.Score for r in after.collect()} == {-1.0}, name
    kept = {n: stage(spark, docs, DATA) for n, stage in corpus_pipeline.STAGES[:4]}
    ids = [r.doc_id for r in kept["n-gram Jaccard join"].collect()]
    assert 60 in ids and not {61, 62} & set(ids) and {50, 51, 52, 53, None} <= set(ids) and ids.count(0) == 3
    cut = {r.doc_id: r for r in kept["substring dedup"].collect()}
    assert cut[70].text == texts[70] and cut[50].text is None and cut[51].text == "" and cut[53].text == texts[53]
    assert all(len(cut[i].text.split()) < 120 and cut[i].n_chars == len(cut[i].text) for i in (71, 72))
    counts = collections.Counter(r.doc_id for r in kept["mixing sources to target weights"].collect())
    assert max(counts[i] for i in texts if i) <= 2 and counts[0] in (0, 3, 6)


def test_quality_stage_is_the_classifier(spark):
    from pyspark.sql import functions as F

    from poolframe.llm import quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    field = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), ~quality.held_out(F.col("doc_id")))
    want = {r.doc_id for r in quality.score(docs, field).where("score >= 0.3").collect()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect()} == want


def test_run_leaves_only_its_result(spark):
    from poolframe.llm.store import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() and [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["packing"]
