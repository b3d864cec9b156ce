"""Small helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy working set holds; a single longer text is taken alone.
WORK_BYTES = 1 << 20

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words (the well-known shift and multiply mixer)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_WORDS = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_PLACES = mix64(np.arange(11, 16, dtype=np.uint64)) | _U(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def runs(starts: np.ndarray, limit: int = WORK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most `limit` bytes, or one row."""
    low, n = 0, len(starts) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word, and how many words each text has.

    `data` holds the texts end to end and `starts` begins at 0.
    """
    inside = ~SEPARATORS[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    place = np.searchsorted(first, starts)
    return first, last, np.diff(place)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold_case: bool) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of one prefix sum of a polynomial."""
    if not len(first):
        return np.zeros(0, np.uint64)
    n = len(data)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_WORDS[_LOWER[data] if fold_case else data] * power, out=total[1:])
    power[:] = _BASE_INVERSE
    power[0] = 1
    np.cumprod(power, out=power)
    return mix64((total[last] - total[first]) * power[first] + (last - first).astype(np.uint64))


def shingles(data: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word shingles of each text, repeats included, and where each text's begin.

    Words are split at `SEPARATORS` and A-Z is lower-cased. A text of fewer words has
    its whole sequence as one shingle, a text without words none.
    """
    first, last, n_words = words(data, starts)
    hashed = span_hashes(data, first, last, True)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n_shingles)])
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    at = np.repeat(first_word[:-1] - begin[:-1], n_shingles) + np.arange(begin[-1])
    length = np.repeat(np.minimum(n_words, width), n_shingles)
    out = length.astype(np.uint64)
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    for k in range(width):
        out += np.where(length > k, padded[at + k] * _PLACES[k % 5] + _U(k), _U(0))
    return mix64(out), begin


def texts_of(batch: pa.RecordBatch, name: str, limit: int = WORK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of a batch's rows with their texts' bytes, end to end, and starts from 0."""
    data, starts = utf8(column(batch, name))
    for low, high in runs(starts, limit):
        yield low, high, data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches that are sorted by the keys.

    Holds one batch and the rows of one key.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(column(batch, k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(low, high - low)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def distinct_shingles(data: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingle hashes in ascending order, and where each text's begin."""
    hashed, begin = shingles(data, starts, width)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    hashed, text = hashed[new], text[new]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(begin) - 1))])


def segment_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the values from each begin to the next, 0 for none; 64-bit sums wrap around."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[begin[1:]] - total[begin[:-1]]
