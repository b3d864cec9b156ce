"""Language identification with a string kernel.

Texts are as like as they have n-grams of bytes in common, over a spectrum of lengths,
present or not. Landmark texts span the kernel's space (Nyström), ridge regression in it
gives a score for each language against the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolframe.llm.arrow import column, mix64, segment_sums, texts_of
from poolframe.llm.sampling import smallest

#: Lengths of n-grams, and the number of places that their hashes are thrown into.
LENGTHS, PLACES = (1, 2, 3, 4), 1 << 13
#: Bytes of a window. A longer text is cut in windows, as it would fill all PLACES.
WINDOW = 1 << 12
#: Windows that are worked on at a time, and those that a text of the training sample gives at most.
AT_ONCE, LEARN = 512, 4

_FACTORS = [np.uint32(f) for f in (2654435761, 2246822519, 3266489917, 668265263)]
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def presence(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text which of the PLACES its n-grams of bytes (A-Z lower-cased) fall on."""
    n = len(starts) - 1
    out = np.zeros((n, PLACES), bool)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
    rest = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(data))
    hashed = np.zeros(len(data), np.uint32)
    single = _BYTE[_LOWER[data]]
    shift = np.uint32(32 - (PLACES.bit_length() - 1))
    for length in range(1, max(LENGTHS) + 1):
        ahead = np.zeros(len(data), np.uint32)
        if length <= len(data):
            ahead[: len(data) - length + 1] = single[length - 1 :]
        hashed = (hashed ^ ahead) * _FACTORS[(length - 1) % 4]
        hashed ^= hashed >> np.uint32(15)
        if length in LENGTHS:
            whole = rest >= length
            out.reshape(-1)[text[whole] * PLACES + ((hashed[whole] * _FACTORS[3]) >> shift)] = True
    return out


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of the windows of texts, and which text each is of.

    A text's windows are equally long, at most WINDOW bytes, and reach as far into the next
    as n-grams across their border do. An empty text has one, too.
    """
    n = np.diff(starts)
    many = np.maximum(-(-n // WINDOW), 1)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    low = starts[text] + n[text] * k // many[text]
    high = starts[text] + n[text] * (k + 1) // many[text]
    return low, np.minimum(high + max(LENGTHS) - 1, starts[text + 1]), text


def window_presence(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    parts = [data[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
    return presence(np.concatenate(parts) if parts else data[:0], np.concatenate([[0], np.cumsum(high - low)]).astype(np.int64))


@dataclass
class Model:
    """Landmarks as presence rows, their norms, and what their kernel values weigh for each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, present: np.ndarray) -> np.ndarray:
        if not self.languages:
            return np.zeros((len(present), 0))
        return kernel(present, self.landmarks) @ self.weights

    def text_scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of whole texts: the mean of those of all of their windows, by length."""
        low, high, text = windows(starts)
        total, size = np.zeros((len(starts) - 1, len(self.languages))), np.maximum(high - low, 1)
        for i in range(0, len(low), AT_ONCE):
            at = slice(i, i + AT_ONCE)
            np.add.at(total, text[at], self.scores(window_presence(data, low[at], high[at])) * size[at, None])
        return total / np.bincount(text, size, len(starts) - 1)[:, None]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams by the geometric mean of both sides' numbers, by a product of matrices."""
    size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a.astype(np.float32) @ b.astype(np.float32).T) / size


def fit(rows: np.ndarray, labels: list[str], landmarks: int = 96, ridge: float = 1e-2, seed: int = 7) -> Model:
    """One-versus-rest kernel ridge regression in the space of landmarks, as many of each label as can be."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, PLACES), bool), np.zeros((0, 0)))
    label, rng = np.array(labels), np.random.default_rng(seed)
    share = -(-landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == x))[:share] for x in languages])
    marks = rows[chosen]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    features = kernel(rows, marks) @ root
    target = (label[:, None] == np.array(languages)[None, :]).astype(float)
    # Each language weighs the same, however many texts it has.
    weight = (1 / (target.sum(0) @ target.T))[:, None]
    solved = np.linalg.solve(features.T @ (weight * features) + ridge * len(languages) / len(rows) * np.eye(features.shape[1]), features.T @ (weight * target))
    return Model(languages, marks, (root @ solved).astype(np.float32))


def train(documents: DataFrame, learn: Column, per_language: int = 500, most: int = 20_000, text: str = "text", language: str = "lang", key: str = "doc_id") -> Model:
    """A model from up to `per_language` documents of each language, of those that meet `learn`, and `most` in all.

    The sample is that with the smallest hashes of the key; of rows with one key and language one counts. From
    its tasks come presence rows of PLACES bits, of LEARN windows of a text at most, evenly spread
    over it. More languages than `most` are an error.
    """
    rows = documents.where(learn & documents[language].isNotNull() & documents[text].isNotNull()).select(documents[key].alias("key"), documents[language].alias("lang"), documents[text].alias("text"))
    languages = rows.select("lang").distinct().count()
    if languages > most:
        raise ValueError(f"{languages} languages, {most} documents are to be learnt from")
    # What it is joined with is as many rows as the sample at most.
    taken = smallest(rows.select("key", "lang").distinct(), "lang", "key", min(per_language, most // max(languages, 1)))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts in texts_of(batch, "text", 1 << 18):
                first, last, own = windows(starts)
                many = np.bincount(own, minlength=high - low)[own]
                k = np.arange(len(own)) - np.searchsorted(own, own)
                some = (many <= LEARN) | ((k + 1) * LEARN // many > k * LEARN // many)
                bits = np.packbits(window_presence(data, first[some], last[some]), axis=1)
                begin = np.searchsorted(own[some], np.arange(high - low + 1))
                bodies = [bits[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.record_batch([column(batch, c).slice(low, high - low) for c in ("key", "lang")] + [pa.array(bodies, pa.binary())], names=["key", "lang", "bits"])

    sampled = rows.join(F.broadcast(taken), ["key", "lang"], "left_semi").mapInArrow(run, f"key {kind}, lang string, bits binary")
    sample = sorted((r.lang, bytes(r.bits)) for r in sampled.groupBy("key", "lang").agg(F.min("bits").alias("bits")).collect())
    bits = np.frombuffer(b"".join(b for _, b in sample), np.uint8).reshape(-1, PLACES // 8)
    return fit(np.unpackbits(bits, axis=1).astype(bool), [x for x, b in sample for _ in range(len(b) * 8 // PLACES)])


def predict(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, lang_pred and score (0 to 1) of every whole text; `und` with score 0 for null texts and those without a letter.

    Also `und` where the model has no language. Keys are passed on as they are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, data, starts in texts_of(batch, "text", 1 << 18):
                lettered = segment_sums(_ASCII_LETTERS[data].astype(np.int64), starts) > 0
                for i in np.flatnonzero(~lettered & (np.diff(starts) > 0)).tolist():
                    lettered[i] = _LETTER.search(data[starts[i] : starts[i + 1]].tobytes().decode()) is not None
                scores = model.text_scores(data, starts)
                if scores.shape[1]:
                    best = scores.argmax(1)
                    names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    score = np.where(lettered, np.clip(scores.max(1), 0, 1), 0.0)
                else:
                    names, score = ["und"] * (high - low), np.zeros(high - low)
                yield pa.record_batch([column(batch, "key").slice(low, high - low), pa.array(names, pa.string()), pa.array(score.astype(float))], names=[key, "lang_pred", "score"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(documents[key].alias("key"), documents[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def remainder(key: Column, by: int) -> Column:
    """CRC-32 of the key as text, modulo `by`; of an absent key, null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))
