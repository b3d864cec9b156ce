import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from poolframe.llm import token_count

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_as_the_library(spark, library):
    rng = random.Random(5)
    texts = ["", " ", "aaaaaaa" * 50, "  \n\n x", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "'S's 't don't", "\x1c\x1d a\x85b\xa0c", "½²³ x²", "日本語 12３", "😀😀", "_a_b__ c_1", "x" * 5000, "!!!! !!", "word " * 4000]
    texts += ["".join(chr(rng.choice([*range(1, 0x600), *range(0x3000, 0x3400)])) if rng.random() < 0.5 else rng.choice(" ab1'\n_") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (None, "two words"), (None, "two words")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_count.count_tokens(docs, VOCABULARY).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(e.ids), len(texts[i].encode())), texts[i]
    assert (got[-1].n_bytes, got[-1].n_tokens, got[-1].over_limit) == (0, 0, False)
    assert got[None].n_tokens == 2
    assert token_count.count_tokens(docs, VOCABULARY).count() == len(texts) + 3
    assert token_count.count_tokens(docs.limit(0), VOCABULARY).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_ids_as_the_library(library):
    import numpy as np

    encoder = token_count.Encoder(token_count.Merger(VOCABULARY), most=3)
    for text in ["some text here", "again <|endoftext|> other text", "yet more of it"]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_as_the_library(library):
    """Every code point after and before a letter, a number, another sign, a space and a contraction."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    table = token_count.stand_ins()
    for low in range(0, len(points), 1 << 16):
        text = "".join(f"a{c}1{c}!{c}'ll{c} {c}" for c in map(chr, points[low : low + (1 << 16)]))
        want = [at for _, at in library.pre_tokenizer.pre_tokenize_str(text)]
        ends = [0]
        for t in token_count.split(text, table):
            ends.append(ends[-1] + len(t))
        assert want == list(zip(ends[:-1], ends[1:], strict=True)), hex(points[low])


def test_usual_texts_need_no_table(library):
    points = [c for c in range(0x240) if not token_count._UNUSUAL[list(chr(c).encode())].any()]
    text = "".join(f"a{c}1{c}!{c}'ll{c} {c}" for c in map(chr, points))
    want = [at[1] - at[0] for _, at in library.pre_tokenizer.pre_tokenize_str(text)]
    assert want == [len(t) for t in token_count.split(text, None)]


def test_other_columns_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "x"), (1, "one two", 5, "x"), (2, "\u0c9c'll", 7, "y")], "doc_id long, text string, n_tokens long, key string")
    got = sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(docs, VOCABULARY).collect())
    assert got[:2] == [(1, 2), (1, 2)] and len(got) == 3
