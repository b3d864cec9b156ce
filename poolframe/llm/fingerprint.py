"""Document fingerprints: one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolframe.llm.arrow import column, distinct_shingles, mix64
from poolframe.llm.store import stored

#: Bins of the one permutation, and the low-order bits of each minimum that are stored.
BINS, BITS = 512, 4

_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
#: For each bin the bins to borrow from, in the order in which they are tried.
_BORROW = np.argsort(mix64(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(BINS, BINS), axis=1)

_SALTS = mix64(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def fingerprints(data: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """BITS low-order bits of every bin for each text, and which texts have any word.

    A shingle's top bits are its bin, and a bin has the least hash. An empty bin takes that
    of the first bin with one in an order of its own, the same for all texts. Low-order bits
    are those of the hash mixed with the bin's number: so bins that took one hash
    are equal by chance no more than others.
    """
    sets, begin = distinct_shingles(data, starts, width)
    n = len(begin) - 1
    text = np.repeat(np.arange(n), np.diff(begin))
    cell = text * BINS + (sets >> _SHIFT).astype(np.int64)
    # Hashes of a text ascend, so the first of a bin is its least.
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    least, has = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    least[cell[first]], has[cell[first]] = sets[first], True
    some = np.diff(begin) > 0
    empty = np.flatnonzero(~has & np.repeat(some, BINS))
    for attempt in range(BINS):
        if not len(empty):
            break
        at = empty // BINS * BINS + _BORROW[empty % BINS, attempt]
        least[empty[has[at]]] = least[at[has[at]]]
        empty = empty[~has[at]]
    bits = mix64(least.reshape(n, BINS) ^ _SALTS) & np.uint64((1 << BITS) - 1)
    return bits.astype(np.uint8), some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimates of the Jaccard likeness, without what equal bits show by chance; 1 for two empty sets."""
    equal = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    chance = 2.0**-BITS
    estimate = np.clip((equal - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, estimate, (some_a == some_b).astype(float))


def packed(prints: np.ndarray, some: np.ndarray) -> list[bytes]:
    """Two bins in a byte; none for a text without words."""
    body = (prints[:, 0::2] << 4 | prints[:, 1::2]).astype(np.uint8)
    return [row.tobytes() if s else b"" for row, s in zip(body, some.tolist(), strict=True)]


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def edited(text: str, other: str) -> str:
    """The text with its last third of code points replaced by the other's first as many."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


#: As stored; the bytes are shown as hex digits in the end.
_FIELDS = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compare(texts: list[str], after: list[str], width: int) -> list[pa.Array]:
    """The fields for texts and those after them."""
    changed = [edited(t, o) for t, o in zip(texts, after, strict=True)]
    (own, some), (theirs, other), (new, has) = (fingerprints(*flat(x), width) for x in (texts, after, changed))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).digest() for c in changed], pa.binary()),
        pa.array(packed(own, some), pa.binary()),
        pa.array(packed(new, has), pa.binary()),
        pa.array(likeness(own, new, some, has)),
        pa.array(likeness(own, theirs, some, other)),
    ]


def _pieces(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def with_edits(documents: DataFrame, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of a text edited from it, and how like they are.

    Returns `key`, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A text is edited by putting the first code points of the
    next document in place of its last third; next is that of the next smaller key, after
    the smallest the largest, rows without a key last and rows of equal keys in order of their
    texts' hashes. A null text is an empty one; texts without words have empty fingerprints,
    that are like each other and nothing else. A document alone is its own next.

    Texts are shuffled once, into ranges of keys, and each is compared with the one after
    it in its range. Only the first and last of every range are joined.
    """
    kind = documents.schema[key].dataType.simpleString()
    ranged = documents.select(documents[key].alias("key"), F.coalesce(documents[text], F.lit("")).alias("text"))
    # Equal rows may change places, so a number tells them apart: rows of one key needn't be one range.
    ranged = ranged.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    order = [F.col("key").desc_nulls_last(), F.col("h"), F.col("m")]
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("part"))
    names = ["part", "edge", "key", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            if held is None:
                yield edge("first", part, batch.slice(0, 1))
            else:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in _pieces(texts[:-1]):
                own = pa.nulls(high - low)
                yield pa.record_batch([pa.array([part] * (high - low), pa.int32()), own.cast(pa.string()), keys.slice(low, high - low), own.cast(pa.string()), *_compare(texts[low:high], texts[low + 1 : high + 1], width)], names=names)
            held = batch.slice(batch.num_rows - 1, 1)
        if held is not None:
            yield edge("last", part, held)

    def edge(which: str, part: int, row: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(1)
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([which]), row.column(0), row.column(1).cast(pa.string()), *(none.cast(t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()))], names=names)

    done = stored(ranged.mapInArrow(run, f"part int, edge string, key {kind}, text string, {_FIELDS}"), "prints")
    inner = done.where("edge IS NULL").select(F.col("key").alias(key), *names[4:])
    # Two rows for each range: their number is that of partitions.
    parts = done.where("edge = 'first'").select("part")
    turn = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())).alias("next"))
    last, first = done.where("edge = 'last'").select("part", "key", "text"), done.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = last.join(following, "part").join(first, "next").select("key", "text", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([column(batch, "key"), *_compare(column(batch, "text").to_pylist(), column(batch, "after").to_pylist(), width)], names=[key, *names[4:]])

    both = inner.unionByName(pairs.mapInArrow(finish, f"`{key}` {kind}, {_FIELDS}"))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
