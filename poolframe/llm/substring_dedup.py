"""Repeated passages, found by content-defined chunks.

A gear hash rolls over the bytes, and a chunk ends where it meets a condition. So the ends
depend on the last bytes alone: a passage has the same chunks wherever it stands, but for
the first and last. From each chunk on, as many chunks as make enough words are a window.
Windows with equal digests are a passage that stands in both texts in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolframe.llm.arrow import SEPARATORS, column, mix64, texts_of, utf8
from poolframe.llm.store import stored, unused

#: Random 32-bit numbers for the bytes.
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32)
#: One in so many bytes may end a chunk, if none of the last LEAST could. This makes chunks of
#: 25 bytes on average; none has fewer than LEAST but a text's first and last.
ONE_IN, LEAST = 18, 6
#: Bytes of the largest chunk, and how many bytes the ends found in a longer one are apart at least.
MOST, APART = 512, 64
#: Windows that a task compares among themselves before they are shuffled.
TOGETHER = 1 << 18


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks of texts end (texts' ends among them): between code points only.

    The hash at a byte is that of the 16 bytes up to it. It must be below a bound for a
    chunk to end there, with no such byte among the last LEAST. No byte of another text counts.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    # Texts stand 16 empty places apart, as many as the hash looks back.
    at = np.arange(len(data)) + 16 * np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    hashed = np.zeros(int(at[-1]) + 1, np.uint32)
    hashed[at] = GEAR[data]
    for step in (1, 2, 4, 8):
        before = np.zeros_like(hashed)
        before[step:] = hashed[:-step] << np.uint32(step)
        hashed = hashed + before
    # Bits from 12 up are those that the window has mixed, bytes beyond it don't reach below 16.
    low = (hashed & np.uint32(0xFFFF)) * np.uint32(0x9E35) & np.uint32(0xFFFF)
    meets = np.zeros(len(low), bool)
    meets[at] = low[at] < np.uint32(0x10000 // ONE_IN)
    near = np.cumsum(meets)
    near = near - np.concatenate([np.zeros(LEAST, near.dtype), near[:-LEAST]])[: len(near)] if len(near) > LEAST else near
    cut = (meets & (near == 1))[at]
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = cut
    ends[starts] = True
    found = np.flatnonzero(ends)
    for a, b in zip(found[:-1].tolist(), found[1:].tolist(), strict=True) if (np.diff(found) > MOST).any() else ():
        if b - a > MOST:
            ends[a + _ends_within(low[at[a:b]], data[a : min(b + 1, len(data))])] = True
    ends[0] = False
    return np.flatnonzero(ends)


def _ends_within(hashed: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where to end chunks in bytes that never meet the condition, such as those of a short period.

    Where the hash is the least of the last APART, APART bytes from the end before at least; where that
    isn't met either, after MOST bytes. `data` has a byte more, if there is one.
    """
    least = np.lib.stride_tricks.sliding_window_view(hashed, APART).min(axis=1)
    meets = np.flatnonzero(hashed[APART - 1 :] == least) + APART
    inner = np.ones(len(hashed) + 1, bool)
    inner[: len(data)] = (data & 0xC0) != 0x80
    out, last = [], 0
    for p in [*meets[inner[meets]].tolist(), len(hashed)]:
        while p - last > MOST:
            last = next(q for q in range(last + MOST, 0, -1) if inner[q])
            out.append(last)
        if p - last >= APART and p < len(hashed):
            out.append(p)
            last = p
    return np.array(out, np.int64)


def chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every chunk, and the text that it belongs to."""
    ends = chunk_ends(data, starts)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    # Empty texts have no chunk: of equal starts the last holds the byte.
    return first, np.searchsorted(starts, first, "right") - 1


def windows(data: np.ndarray, starts: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts: which text, first and last-plus-one byte in it, and digest (two columns of 64 bits).

    A window begins with any chunk and is as many chunks as have `least_words` words, parts of words
    included; where a text has no such number left there is none.
    """
    first, own = chunks(data, starts)
    if not len(first):
        return own, first, first, np.zeros((0, 2), np.int64)
    ends = np.append(first[1:], len(data))
    inside = ~SEPARATORS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[starts[:-1][np.diff(starts) > 0]] = inside[starts[:-1][np.diff(starts) > 0]]
    before = np.concatenate([[0], np.cumsum(begins)])
    wanted = before[first] + least_words - (inside[first] & ~begins[first])
    last = np.maximum(np.searchsorted(before[ends], wanted), np.arange(len(first)))
    whole = last < len(first)
    whole[whole] = own[last[whole]] == own[whole]
    low, high, own = first[whole], ends[last[whole]], own[whole]
    raw = data.tobytes()
    digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    return own, low - starts[own], high - starts[own], np.frombuffer(digests, "<i8").reshape(-1, 2)


def repeated_spans(low: np.ndarray, high: np.ndarray, data: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """Byte ranges of one text that windows which are repeats cover in one piece, from word to word.

    What a range cuts of a word at either end stays.
    """
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    out = []
    for a, b in zip(low[new].tolist(), reach[np.append(new[1:], len(low)) - 1].tolist(), strict=True):
        gap = SEPARATORS[data[a:b]]
        if int((gap[:-1] & ~gap[1:]).sum()) + int(len(gap) > 0 and not gap[0]) < least_words:
            continue
        if a and not gap[0] and not SEPARATORS[data[a - 1]]:
            a += int(np.argmax(gap))
        if b < len(data) and not gap[-1] and not SEPARATORS[data[b]]:
            b -= int(np.argmax(gap[::-1]))
        out.append((a, b))
    return out


_WINDOW = ["d1", "d2", "doc_id", "t", "low", "high", "sure"]


def _combined(digest: np.ndarray, doc: pa.Array, t: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Of windows that lie in one task those that may be the first of their digest, and those that are `sure` to be repeats.

    Sure ones have a document of smaller key beside them, or their own text further up, and are dealt
    anywhere. So however many texts have a passage, a task sends one of each of its windows to the task of its digest.
    """
    rank = pc.rank(doc, tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((low, t, rank, digest[:, 1], digest[:, 0]))
    digest, rank, t, low, high = digest[order], rank[order], t[order], low[order], high[order]
    same = np.zeros(len(order), bool)
    same[1:] = (digest[1:] == digest[:-1]).all(axis=1)
    least = rank[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    in_text, twin = same.copy(), same.copy()
    in_text[1:] &= (rank[1:] == rank[:-1]) & (t[1:] == t[:-1])
    twin[1:] = in_text[1:] & (low[1:] == low[:-1])
    sure = (rank != least) | in_text
    away = mix64((digest[:, 0] ^ t).view(np.uint64) + low.astype(np.uint64)).view(np.int64)
    keep = np.flatnonzero(~twin)
    columns = [np.where(sure, away, digest[:, 0]), digest[:, 1], t, low.astype(np.int32), high.astype(np.int32), sure]
    arrays = [pa.array(c[keep]) for c in columns]
    return pa.record_batch([*arrays[:2], doc.take(pa.array(order[keep])), *arrays[2:]], names=_WINDOW)


class Marker:
    """Tells of windows in order of digest, document, text and place which are repeats; holds two at a time."""

    def __init__(self) -> None:
        self.last: pa.Table | None = None

    def repeats(self, batch: pa.RecordBatch) -> pa.Table:
        rows = pa.Table.from_batches([batch])
        sure = rows.filter(rows["sure"])
        rows = rows.filter(pc.invert(rows["sure"]))
        n = 0 if self.last is None else self.last.num_rows
        if not rows.num_rows:
            return sure
        both = rows if self.last is None else pa.concat_tables([self.last, rows])
        d1, d2, t, low = (both[c].to_numpy() for c in ("d1", "d2", "t", "low"))
        doc = both["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        same = np.zeros(len(d1), bool)
        same[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
        in_text = same.copy()
        in_text[1:] &= (doc[1:] == doc[:-1]) & (t[1:] == t[:-1])
        begin, of_text = (np.maximum.accumulate(np.where(x, 0, np.arange(len(d1)))) for x in (same, in_text))
        # Equal rows of documents have equal windows; only what is further down is a repeat of its own text.
        again = (doc != doc[begin]) | (low > low[of_text])
        again[:n] = False
        # The first of the last digest, and that in its last text, as what follows may go on with them.
        self.last = both.take(pa.array([begin[-1], of_text[-1]]))
        return pa.concat_tables([sure, both.filter(pa.array(again))])


def remove_repeats(documents: DataFrame, least_words: int = 34, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with repeated passages cut from their texts.

    Adds n_removed (bytes cut) and removed (their ranges in the UTF-8 of the text as it
    was, as an array of structs low, high); columns of these names are replaced. A window of
    at least `least_words` words is a repeat if one document of smaller key has all of it in one
    piece, or the text itself further up. So one copy of a passage stays. Repeats of fewer
    words stay as well: phrases and short common lines, also where several from different
    documents stand in a row. Of a repeated passage what lies before its first chunk and after
    its last whole window stays: some chunks at most. As a window is whole chunks, passages are found surely only
    if they are some 20 words longer than `least_words`; most are from fewer words on.

    Null and empty texts stay as they are. Rows without a key stay too and count for nothing; rows of
    one key count as one document. Windows are told apart by 128-bit digests of their bytes.

    Texts are cut in chunks once. Windows are shuffled by digest, after each task has
    compared its own, so a passage of very many texts is no hot spot; texts are shuffled by key once.
    """
    hashed = F.xxhash64(documents[text])
    slim = documents.where(documents[key].isNotNull() & documents[text].isNotNull()).select(documents[key].alias("doc_id"), documents[text].alias("text"), hashed.alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            doc, t = column(batch, "doc_id"), column(batch, "t").to_numpy()

            def made(held: list[tuple], doc: pa.Array = doc, t: np.ndarray = t) -> pa.RecordBatch:
                row, low, high, digest = (np.concatenate(x) for x in zip(*held, strict=True))
                return _combined(digest, doc.take(pa.array(row)), t[row], low, high)

            for begin, _, data, starts in texts_of(batch, "text"):
                own, low, high, digest = windows(data, starts, least_words)
                held.append((own + begin, low, high, digest))
                if sum(len(x[0]) for x in held) >= TOGETHER:
                    yield made(held)
                    held = []
            if held:
                yield made(held)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker()
        for batch in batches:
            yield from marker.repeats(batch).select(["doc_id", "t", "low", "high"]).to_batches()

    kind = slim.schema["doc_id"].dataType.simpleString()
    cuts = slim.mapInArrow(cut, f"d1 bigint, d2 bigint, doc_id {kind}, t bigint, low int, high int, sure boolean")
    marked = cuts.repartition("d1").sortWithinPartitions("d1", "d2", "doc_id", "t", "low").mapInArrow(mark, f"doc_id {kind}, t bigint, low int, high int")
    repeats = stored(marked.groupBy("doc_id", "t").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "repeats")
    own, place, found = (unused(n, documents) for n in ("of_doc", "of_text", "ranges"))
    repeats = repeats.select(F.col("doc_id").alias(own), F.col("t").alias(place), F.col("ranges").alias(found))
    joined = documents.drop("n_removed", "removed").join(repeats, (documents[key] == F.col(own)) & (hashed == F.col(place)), "left").drop(own, place)
    names = [c for c in joined.columns if c != found]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            lists, whole = column(batch, found), column(batch, text)
            removed, gone, changed = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows, {}
            data, starts = utf8(whole)
            for row in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                body, ranges = data[starts[row] : starts[row + 1]], lists[row].values
                spans = repeated_spans(*(ranges.field(c).to_numpy().astype(np.int64) for c in (0, 1)), body, least_words)
                keep = np.ones(len(body), bool)
                for x, y in spans:
                    keep[x:y] = False
                if spans:
                    changed[row] = body[keep].tobytes().decode()
                    removed[row], gone[row] = len(body) - keep.sum(), [{"low": x, "high": y} for x, y in spans]
            columns = [column(batch, c) for c in names]
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                columns[names.index(text)] = pc.replace_with_mask(whole, pa.array(mask), pa.array(changed.values(), whole.type))
            yield pa.record_batch([*columns, pa.array(removed), pa.array(gone, span)], names=[*names, "n_removed", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != found)
    return joined.mapInArrow(apply, schema + ", n_removed bigint, removed array<struct<low: bigint, high: bigint>>")
