import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from poolframe.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, length=2048):
    """Every id lies in one piece, sequences have no gap and none needs padding."""
    library = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0


def test_pieces(spark):
    texts = {1: "a few words <|endoftext|> more", 2: None, 3: "", 4: "long text of words, " * 3000, 5: "x" * 9000, 6: "ñandú 中文 ½"}
    docs = spark.createDataFrame([(k, v, "other") for k, v in texts.items()], "doc_id long, text string, start string").coalesce(1)
    check(packing.pack(docs, VOCABULARY).collect(), texts)


def test_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "same"), (7, "same")], "doc_id long, text string")
    rows = packing.pack(docs, VOCABULARY, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in rows if r.start == 0) != []
    assert sum(r.length for r in rows) == 2 * 3 + 2 * 2
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def naive(lengths, room, linear, quadratic):
    """The rule, word for word."""
    state, out = [[r, 0.0] for r in room], []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, rest = 0, lengths[d]
        while rest and any(r for r, _ in state):
            able = [s for s, (r, _) in enumerate(state) if r >= rest] or [s for s, (r, _) in enumerate(state) if r]
            at = min(able, key=lambda s: (state[s][1], s))
            n = min(rest, state[at][0])
            out.append((d, start, n, at))
            state[at][0] -= n
            state[at][1] += linear * n + quadratic * n * n
            start, rest = start + n, rest - n
    return out


def test_lowest_cost_is_taken():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 2049, rng.integers(1, 40))
        total = int(lengths.sum())
        for room in (np.full(total // 2048, 2048), np.concatenate([np.full(total // 2048, 2048), packing.powers(total % 2048)])):
            got, over = packing.assign(lengths, room, 1.0, 1 / 1024)
            assert got == naive(lengths.tolist(), room.tolist(), 1.0, 1 / 1024)
            assert sum(int(lengths[d]) - start for d, start in over) == total - int(room.sum())


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = rng.integers(20, 600, 400)
    room = np.full(int(lengths.sum()) // 2048, 2048)
    got, _ = packing.assign(lengths, room, 1.0, 1 / 1024)
    cost = np.zeros(len(room))
    for _, _, n, at in got:
        cost[at] += n + n * n / 1024
    assert cost.max() / cost.mean() < 1.1


def test_remainders_go_on_to_the_next_block(spark):
    texts = {i: "some words of a text " * (i % 40) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, VOCABULARY, length=64, block_tokens=200).collect()
    check(rows, texts, 64)
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert sum(e < 64 for e in ends.values()) <= 6
