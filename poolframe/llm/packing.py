"""Packing token sequences to a fixed length, balanced by what attention over them costs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from poolframe.llm.arrow import column, texts_of
from poolframe.llm.token_count import Encoder, Merger


def assign(lengths: np.ndarray, room: np.ndarray, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pieces (stretch, start, length, sequence) that fill sequences with `room` tokens each, and
    what is left when all are full, as (stretch, start).

    Stretches come in descending length (ties as given), each goes to the sequence of lowest
    estimated cost among those that have room for all of it, the first of equal ones; where none has,
    it is cut over those of lowest cost that have any. A piece of n tokens costs
    linear * n + quadratic * n * n.
    """
    room, cost, out, over = room.copy(), np.zeros(len(room)), [], []
    for d in np.argsort(-lengths, kind="stable").tolist():
        start, rest = 0, int(lengths[d])
        while rest:
            fits = room >= rest
            if not fits.any():
                fits = room > 0
            if not fits.any():
                over.append((d, start))
                break
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(rest, int(room[at]))
            out.append((d, start, n, at))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, rest = start + n, rest - n
    return out, over


def powers(tokens: int) -> np.ndarray:
    """The powers of two that make up a number, the largest first."""
    return np.array([1 << k for k in range(tokens.bit_length() - 1, -1, -1) if tokens >> k & 1], np.int64)


@dataclass
class Stretch:
    """Ids of a document from `start` on, at most a sequence's length."""

    key: object
    start: int
    whole: int
    ids: np.ndarray

    def rest(self, start: int) -> Stretch:
        return Stretch(self.key, self.start + start, self.whole, self.ids[start:])


def pack(
    documents: DataFrame,
    vocabulary: str,
    length: int = 2048,
    end_id: int = 1,
    block_tokens: int = 1 << 19,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most `length` tokens.

    Returns a row per piece: `key`, start, length, ids_crc32 (of little-endian unsigned
    32-bit ids), doc_tokens, sequence_id, offset, and with `with_ids` the piece's ids.
    A document's ids are those of its whole text and `end_id`; null and empty texts have
    that one alone. A document is cut in stretches of `length` and what is left, and all of
    these are assigned by cost (see `assign`), in blocks of about `block_tokens` within a partition,
    so nothing is shuffled, and a lost task is made again alike. A block fills whole
    sequences; what is left, less than one, goes on to the next block. Only the last tokens of a
    partition fill sequences of powers of two, so none is padded. Rows with equal or null
    keys are documents of their own; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Merger(vocabulary))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        sequence = TaskContext.get().partitionId() << 36
        kind = None
        held: list[Stretch] = []
        rows: list[tuple] = []
        bodies: list[np.ndarray] = []

        def flush(room: np.ndarray) -> None:
            nonlocal sequence, held
            filled = np.zeros(len(room), np.int64)
            pieces, over = assign(np.array([len(x.ids) for x in held], np.int64), room, linear, quadratic)
            for d, start, n, at in pieces:
                x, ids = held[d], held[d].ids[start : start + n]
                rows.append((x.key, x.start + start, n, zlib.crc32(ids.astype("<u4").tobytes()), x.whole, sequence + at, int(filled[at])))
                if with_ids:
                    bodies.append(ids)
                filled[at] += n
            sequence += len(room)
            held = [held[d].rest(start) for d, start in over]

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]
            if with_ids:
                ends = np.cumsum([0, *map(len, bodies)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(bodies).astype(np.int32)))
            rows.clear()
            bodies.clear()
            return pa.record_batch(arrays, names=names)

        for batch in batches:
            kind = column(batch, "key").type
            for low, high, data, starts in texts_of(batch, "text", 1 << 20):
                ids, begin = encoder.encode(data, starts)
                for name, a, b in zip(column(batch, "key").slice(low, high - low).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.int32(end_id))
                    held += [Stretch(name, at, len(own), own[at : at + length]) for at in range(0, len(own), length)]
                tokens = sum(len(x.ids) for x in held)
                if tokens >= block_tokens:
                    flush(np.full(tokens // length, length, np.int64))
                    yield out()
        tokens = sum(len(x.ids) for x in held)
        flush(np.concatenate([np.full(tokens // length, length, np.int64), powers(tokens % length)]))
        if rows:
            yield out()

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    chosen = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(place, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
