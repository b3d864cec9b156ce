import random

import numpy as np

from poolframe.llm import substring_dedup


def test_chunks_resist_shifts():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh äö€\n", k=3000)).encode()
    for before in (b"", b"x", b"some more text"):
        data = np.frombuffer(before + passage, np.uint8)
        ends = substring_dedup.chunk_ends(data, np.array([0, len(data)])) - len(before)
        if not before:
            plain = set(ends.tolist())
        assert {e for e in ends.tolist() if e > 100} == {e for e in plain if e > 100}
        for e in ends.tolist():
            (before + passage)[: e + len(before)].decode()
    assert 100 < len(plain) < 170


def test_texts_are_cut_apart():
    texts = [b"", b"one text here", b"", b"another one", b""]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, own = substring_dedup.chunks(np.frombuffer(b"".join(texts), np.uint8), starts)
    assert set(own.tolist()) == {1, 3} and set(starts[[1, 3]]) <= set(first.tolist())


def test_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(8)
    words = lambda k: " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(k))
    passage = words(80)
    clean = {i: words(rng.choice([3, 100, 400])) for i in range(20)}
    hit = {i: words(60) + " " + passage + " " + words(60) for i in range(100, 130)}
    other = {500: None, 501: "", 502: clean[1], 503: passage}
    rows = [(k, v, i) for i, (k, v) in enumerate({**clean, **hit, **other}.items())] + [(None, passage, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digests int").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert len(got) == len(rows) and got[500].text is None and got[None].text == passage
    for k, v in clean.items():
        assert got[k].text == v and got[k].n_removed == 0
    assert got[100].text == hit[100]
    for k in range(101, 130):
        assert len(got[k].text.split()) < 121 + 40 and got[k].n_removed > 0
        low, high = got[k].removed[0]
        assert hit[k].encode()[low:high].decode() in hit[k]
        assert got[k].text.startswith(hit[k][:200]) and got[k].text.endswith(hit[k][-200:])
    if len(clean[1].split()) > 60:
        assert len(got[502].text) < 60
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert got[7].digests if 7 in got and 7 not in clean else True


def test_repeats_within_a_text(spark):
    line = "a line of some fifteen words that is often repeated within one text as it goes on"
    docs = spark.createDataFrame([(1, "\n".join([line] * 20))], "doc_id long, text string")
    (row,) = substring_dedup.remove_repeats(docs).collect()
    assert len(row.text) < 3 * len(line)


def test_chunks_of_different_documents_are_no_passage(spark):
    rng = random.Random(5)
    clean = " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(300))
    data = np.frombuffer(clean.encode(), np.uint8)
    ends = substring_dedup.chunk_ends(data, np.array([0, len(data)])).tolist()
    # Each chunk of the text is in a document of its own, with what comes before it.
    parts = [clean[max(0, low - 22) : high] for low, high in zip([0, *ends], ends, strict=False)]
    parts = [x for x in parts if len(x.split()) < 12]
    assert len(parts) > 20
    docs = spark.createDataFrame([*enumerate(parts), (1000, clean), (1001, "before it " + clean)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1000].text == clean and got[1000].n_removed == 0
    assert got[1001].n_removed > 0.8 * len(clean)


def test_chunks_do_not_depend_on_the_text_before():
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh ", k=400)).encode()
    alone = substring_dedup.chunk_ends(np.frombuffer(text, np.uint8), np.array([0, 400])).tolist()
    for _ in range(40):
        before = "".join(rng.choices("abcdefgh ", k=30)).encode()
        both = substring_dedup.chunk_ends(np.frombuffer(before + text, np.uint8), np.array([0, 30, 430]))
        assert [e - 30 for e in both.tolist() if e > 30] == alone


def naive_ends(text):
    """Chunk ends by rolling over the bytes one at a time, for texts without longer chunks than MOST."""
    ends, met = [], []
    for i in range(len(text)):
        h = 0
        for b in text[max(0, i - 15) : i + 1]:
            h = (h * 2 + int(substring_dedup.GEAR[b])) % 2**32
        met.append((h % 65536 * 0x9E35) % 65536 < 65536 // substring_dedup.ONE_IN)
        inner = i + 1 < len(text) and text[i + 1] & 0xC0 == 0x80
        if met[-1] and sum(met[-substring_dedup.LEAST :]) == 1 and not inner:
            ends.append(i + 1)
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def naive_removal(rows, least_words):
    """Bytes of each row that windows cover which a smaller key has, or the text itself further up."""
    found, firsts = [], {}
    for key, text in rows:
        body = (text or "").encode()
        own, low, high, _ = substring_dedup.windows(np.frombuffer(body, np.uint8), np.array([0, len(body)]), least_words)
        found.append([(a, b, body[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        for _, _, piece in found[-1]:
            firsts[piece] = min(firsts.get(piece, key), key)
    out = []
    for (key, text), own in zip(rows, found, strict=True):
        gone, seen = set(), set()
        for a, b, piece in own:
            if firsts[piece] != key or piece in seen:
                gone |= set(range(a, b))
            seen.add(piece)
        out.append(gone)
    return out


def test_chunk_ends_equal_rolling():
    rng = random.Random(11)
    text = "".join(rng.choices("abcdefgh äö€\n", k=900)).encode()
    assert substring_dedup.chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist() == naive_ends(text)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", 50)
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 70))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 5))]
        rows.append((i if i % 10 else 7, "\n".join(parts)))
    rows += rows[:9] + [(500, ""), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((k, t or "", len(g)) for (k, t), g in zip(rows, naive_removal(rows, 12), strict=True))
    got = sorted((r.doc_id, r.n_removed, sum(x.high - x.low for x in r.removed), r.text) for r in substring_dedup.remove_repeats(docs, least_words=12).collect())
    assert len(got) == len(want) and all(n == spans for _, n, spans, _ in got)
    # Ranges end at words, so a few bytes at either end of a covered one stay.
    for key in {k for k, *_ in got}:
        naive, own = [g for k, _, g in want if k == key], [n for k, n, *_ in got if k == key]
        assert sum(own) <= sum(naive) and sum(own) >= sum(naive) - 30 * sum(1 for g in naive if g) * 5
        assert (sum(own) == 0) == (sum(naive) == 0) or sum(naive) < 100
    assert sum(n for _, n, *_ in got) > 0.85 * sum(g for *_, g in want) > 0


def test_largest_chunk():
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    for text in ("it " * 2000, "a" * 5000, morse, "ab" * 3000, "é" * 3000, "no end " * 1000):
        data = np.frombuffer(text.encode(), np.uint8)
        ends = [0, *substring_dedup.chunk_ends(data, np.array([0, len(data)])).tolist()]
        assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= substring_dedup.MOST and ends[-1] == len(data)
        for e in ends:
            data[:e].tobytes().decode()


def test_periodic_copies_are_found(spark):
    rng = random.Random(3)
    words = lambda k: " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(k))
    run = "it is so " * 400
    docs = spark.createDataFrame([(i, words(20 + i) + " " + run + words(20)) for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert all(got[i].n_removed > 0.8 * len(run) for i in range(1, 4))


def test_texts_with_equal_polynomials_stay(spark):
    """Strings of Thue and Morse and their inverses have equal polynomial hashes modulo 2**64 in any base."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    spaced = [" ".join(morse[i : i + 8] for i in range(0, 4096, 8)), " ".join(morse.translate(str.maketrans("ab", "ba"))[i : i + 8] for i in range(0, 4096, 8))]
    docs = spark.createDataFrame(list(enumerate(spaced)), "doc_id long, text string")
    alone = [substring_dedup.remove_repeats(docs.where(f"doc_id = {i}")).first().n_removed for i in (0, 1)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    want = naive_removal(list(enumerate(spaced)), 30)
    assert got[0].n_removed == alone[0] and got[1].n_removed <= len(want[1])


def test_long_text_and_empty_table(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(180_000))
    docs = spark.createDataFrame([("a", "start " + long, 1), ("b", long, 2)], "doc_id string, text string, removed int")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got["a"].n_removed == 0 and len(got["b"].text) < 400
    assert substring_dedup.remove_repeats(docs.limit(0)).columns == ["doc_id", "text", "n_removed", "removed"]
