"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; what tells is the line's own features, those of the lines
before and after it, and the label of the line before. A document's score is the mean
probability of its lines being good, weighted by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolframe.llm.arrow import column, segment_sums, span_hashes, texts_of, words
from poolframe.llm.language import remainder
from poolframe.llm.sampling import smallest
from poolframe.llm.store import stored

#: Where the ranges of each measure of a line are cut; a line has one feature of each measure.
EDGES = {
    "upper_of_letters": [0.01, 0.05, 0.1, 0.2, 0.4, 0.7],
    "symbols": [0.001, 0.02, 0.05, 0.1, 0.2, 0.4],
    "digits": [0.001, 0.02, 0.1, 0.3, 0.6],
    "punctuation": [0.01, 0.03, 0.06, 0.12, 0.25],
    "beyond_ascii": [0.001, 0.02, 0.1, 0.3, 0.6],
    "words_ending_in_symbols": [0.02, 0.1, 0.3, 0.6, 0.9],
    "words_like_the_last": [0.02, 0.1, 0.3, 0.6, 0.9],
    "distinct_words": [0.2, 0.4, 0.6, 0.8, 0.95],
    "bytes_of_a_word": [2, 3, 4, 5, 6, 8, 12],
    "words": [1, 2, 4, 8, 16, 32, 64, 128, 512],
    "line_seen_before": [0.5],
    "ends_a_sentence": [0.5],
    "begins_small": [0.5],
}
WIDTHS = [len(e) + 1 for e in EDGES.values()]
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
FEATURES = sum(WIDTHS)


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _SMALL, _DIGIT = (_of("".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in ("AZ", "az", "09"))
_SYMBOL, _PUNCTUATION, _END = _of("#$%&*|!@^~_<>{}[]\\/+="), _of(".,;:?-'\"()"), _of(".!?")
_HIGH = np.arange(256) >= 128


def lines(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of every line's features, lines' lengths, and where each text's lines begin; a text has a line at least."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([starts[:-1], breaks + 1]))
    end = np.sort(np.concatenate([starts[1:], breaks]))
    # Of an empty text and the text after it both lines begin at one byte; order among them is the texts'.
    counts = np.diff(np.searchsorted(breaks, starts)) + 1
    text_begin = np.concatenate([[0], np.cumsum(counts)])
    n = len(begin)

    def per_line(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (total[end] - total[begin]).astype(float)

    first, last, _ = words(data, starts)
    hashed = span_hashes(data, first, last, True)
    at = np.searchsorted(begin, first, "right") - 1
    n_words = np.bincount(at, minlength=n).astype(float)
    ending = np.bincount(at, _SYMBOL[data[last - 1]], minlength=n)
    again = np.zeros(len(first), bool)
    again[1:] = (at[1:] == at[:-1]) & (hashed[1:] == hashed[:-1])
    order = np.lexsort((hashed, at))
    fresh = np.ones(len(first), bool)
    fresh[1:] = (np.diff(at[order]) != 0) | (hashed[order][1:] != hashed[order][:-1])
    distinct = np.bincount(at[order][fresh], minlength=n).astype(float)
    # The words' order is left out: lines of the same words count as one line again.
    whole = segment_sums(hashed, np.concatenate([[0], np.cumsum(n_words.astype(np.int64))]))
    text = np.repeat(np.arange(len(counts)), counts)
    by = np.lexsort((np.arange(n), whole, text))
    seen = np.zeros(n, bool)
    seen[by[1:]] = (whole[by[1:]] == whole[by[:-1]]) & (text[by[1:]] == text[by[:-1]]) & (n_words[by[1:]] > 0)

    shown = np.maximum(per_line((data > 32).astype(np.int8)), 1)
    upper, some = per_line(_UPPER[data]), np.maximum(n_words, 1)
    letters = np.maximum(upper + per_line(_SMALL[data]), 1)
    padded = np.append(data, 0)
    filled = end > begin
    measures = [
        upper / letters,
        per_line(_SYMBOL[data]) / shown,
        per_line(_DIGIT[data]) / shown,
        per_line(_PUNCTUATION[data]) / shown,
        per_line(_HIGH[data]) / shown,
        ending / some,
        np.bincount(at, again, minlength=n) / np.maximum(n_words - 1, 1),
        np.where(n_words > 0, distinct / some, 1),
        shown / some,
        n_words,
        seen,
        filled & _END[padded[np.maximum(end - 1, 0)]],
        filled & _SMALL[padded[begin]],
    ]
    codes = np.stack([np.searchsorted(e, m, "right") for e, m in zip(EDGES.values(), measures, strict=True)], axis=1)
    return (codes + OFFSETS).astype(np.int64), end - begin, text_begin


@dataclass
class Field:
    """Weights of features of the line itself, the one before and the one after, a bias, and of transitions."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray

    def scores(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How much more each line's surroundings speak for good than for bad."""
        own, before, after = (w[codes].sum(1) for w in self.weights)
        out = own + self.bias
        first = np.zeros(len(codes), bool)
        first[begin[:-1]] = True
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(first[1:], 0, after[1:])
        return out


def marginals(scores: np.ndarray, begin: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of every line the probability of being good, of each pair with the line before (at the
    later line, by both labels), and the sum of the logs of partition functions.

    Forward and backward over all texts together: step t takes the t-th line of every text
    that has one.
    """
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    start, length = begin[:-1][order], length[order]
    n, move = len(scores), np.exp(steps)
    local = np.stack([np.ones(n), np.exp(np.clip(scores, -30, 30))], axis=1)
    ahead, back, log = np.zeros((n, 2)), np.ones((n, 2)), 0.0
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    state = np.ones((len(length), 2)) / 2
    for t, k in enumerate(active.tolist()):
        state = (state[:k] @ move if t else np.ones((k, 2))) * local[start[:k] + t]
        total = state.sum(1, keepdims=True)
        log += float(np.log(total).sum())
        state = state / total
        ahead[start[:k] + t] = state
    pair = np.zeros((n, 2, 2))
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        after = start[:k] + t + 1
        reach = back[after] * local[after]
        joint = ahead[after - 1][:, :, None] * move[None] * reach[:, None, :]
        pair[after] = joint / joint.sum((1, 2), keepdims=True)
        reach = reach @ move.T
        back[after - 1] = reach / reach.sum(1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(1), pair, log


def flat(field: Field) -> np.ndarray:
    return np.concatenate([field.weights.ravel(), [field.bias], field.steps.ravel()])


def unflat(value: np.ndarray) -> Field:
    return Field(value[: 3 * FEATURES].reshape(3, FEATURES), float(value[3 * FEATURES]), np.clip(value[-4:].reshape(2, 2), -8, 8))


def gradient(field: Field, codes: np.ndarray, begin: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of lines' labels, by the field's numbers in the order of `flat`: what is seen less what is expected."""
    first = np.zeros(len(codes), bool)
    first[begin[:-1]] = True
    inner = ~first
    own, pair, _ = marginals(field.scores(codes, begin), begin, field.steps)
    before = np.concatenate([[0], label[:-1]])
    seen = np.array([[((before == a) & (label == b) & inner).sum() for b in (0, 1)] for a in (0, 1)], float)
    off = label - own
    # A line's codes weigh for the line after it as `before`, for the line before it as `after`.
    of_next = np.append(np.where(first[1:], 0, off[1:]), 0)
    of_last = np.where(first, 0, np.concatenate([[0], off[:-1]]))
    width = codes.shape[1]
    return np.concatenate(
        [
            np.bincount(codes.ravel(), np.repeat(off, width), minlength=FEATURES),
            np.bincount(codes.ravel(), np.repeat(of_next, width), minlength=FEATURES),
            np.bincount(codes.ravel(), np.repeat(of_last, width), minlength=FEATURES),
            [off.sum()],
            (seen - pair[inner].sum(0)).ravel(),
        ]
    )


def fit(codes: np.ndarray, begin: np.ndarray, good: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """The field that makes the labels of lines (each its text's) likeliest, by gradient steps on the mean log-likelihood."""
    label = np.repeat(good.astype(float), np.diff(begin))
    value = np.zeros(3 * FEATURES + 5)
    field, mean, square = unflat(value), np.zeros_like(value), np.zeros_like(value)
    for step in range(1, rounds + 1):
        up = gradient(field, codes, begin, label) / max(1, len(begin) - 1) - decay * value
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up**2
        value = value + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        field = unflat(value)
    return field


def train(
    documents: DataFrame, labels: DataFrame, learn: Column, per_label: int = 1500, most_lines: int = 150_000, longest: int = 2000, text: str = "text", key: str = "doc_id", label: str = "quality"
) -> Field:
    """A field from labelled documents that meet `learn` (of the labels' key): up to `per_label` of
    each label, those with the smallest hashes of the key, with all of their lines.

    The sample's bounds choose documents, never parts of them: of each label they have `most_lines`
    lines together at most (documents that don't fit in any more are passed over), and none has more than `longest`.
    Of rows with one key one counts, that with the fewest lines. Only the codes of the sample's
    features go to the driver. Rows without a label are left out. Without any labelled row every line is
    good with probability a half.
    """
    marked = labels.where(learn & labels[label].isNotNull() & labels[key].isNotNull()).select(labels[key].alias("key"), labels[label].cast("int").alias("good"))
    taken = smallest(marked.groupBy("key").agg(F.max("good").alias("good")), "good", "key", per_label)
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text")).join(F.broadcast(taken), "key").select("key", "good", "text")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts in texts_of(batch, "text"):
                codes, _, begin = lines(data, starts)
                n = np.diff(begin)
                bodies = [codes[a:b].astype(np.uint8).tobytes() if b - a <= longest else None for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.record_batch([column(batch, "key").slice(low, high - low), column(batch, "good").slice(low, high - low), pa.array(n, pa.int64()), pa.array(bodies, pa.binary())], names=["key", "good", "n", "codes"])

    coded = rows.mapInArrow(run, f"key {kind}, good int, n bigint, codes binary").where("codes IS NOT NULL")
    one = stored(coded.groupBy("key", "good").agg(F.min(F.struct("n", "codes")).alias("x")).select("key", "good", F.xxhash64("key").alias("h"), "x.*"), "sample")
    # As many rows as there are sampled keys.
    left, fits = dict.fromkeys((0, 1), most_lines), []
    for r in sorted(one.select("h", "key", "good", "n").collect()):
        if r.n <= left.setdefault(r.good, most_lines):
            left[r.good] -= r.n
            fits.append((r.key,))
    if not fits:
        return Field(np.zeros((3, FEATURES)), 0.0, np.zeros((2, 2)))
    chosen = documents.sparkSession.createDataFrame(fits, f"key {kind}")
    sample = sorted((bytes(r.codes), r.good) for r in one.join(F.broadcast(chosen), "key").select("codes", "good").collect())
    codes = np.frombuffer(b"".join(c for c, _ in sample), np.uint8).reshape(-1, len(WIDTHS)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum([len(c) // len(WIDTHS) for c, _ in sample])])
    return fit(codes, begin, np.array([g for _, g in sample]))


def scored_rows(documents: DataFrame, field: Field, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 if score >= threshold, else 0) of every whole text.

    Columns of these names are replaced. Lines end at line feeds; a null or empty text
    has one empty line. A line weighs its bytes and one. Null and repeated keys don't matter:
    nothing is joined, each row keeps its columns.
    """
    documents = documents.drop("score", "predicted")
    names = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for low, high, data, starts in texts_of(batch, text):
                codes, length, begin = lines(data, starts)
                good, _, _ = marginals(field.scores(codes, begin), begin, field.steps)
                weight = (length + 1).astype(float)
                total = np.clip(segment_sums(good * weight, begin) / segment_sums(weight, begin), 0, 1)
                yield pa.record_batch([*batch.slice(low, high - low).columns, pa.array(total), pa.array((total >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.schema.fields)
    return documents.mapInArrow(run, schema + "score double, predicted int")


def score(documents: DataFrame, field: Field, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, score and predicted of every document, as in `scored_rows`; other columns are not read."""
    return scored_rows(documents.select(key, text), field, threshold, text).select(key, "score", "predicted")


def held_out(key: Column, by: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the key as text leaves `fold` modulo `by`; an absent key isn't held out."""
    return F.coalesce(remainder(key, by) == fold, F.lit(False))
