"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, pre_tokenizers

from poolframe.llm.arrow import column, texts_of

#: Fixed value: the pattern that splits text into pre-tokens for this family of vocabularies, as `re` has its
#: classes in texts without `_UNUSUAL` bytes and in stand-ins (see `stand_ins`).
_SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Bytes of texts in which some code point may be of another class for the library than for `re`: control
#: characters that only `re` has as spaces, U+0080 to U+00BF, and all from U+0240 on.
_UNUSUAL = np.zeros(256, bool)
_UNUSUAL[[*range(0x1C, 0x20), 0xC2, *range(0xC9, 0x100)]] = True


@cache
def stand_ins() -> np.ndarray:
    """For every code point an ASCII one of the same class (letter, number, space, other), as the library has it.

    ASCII stands for itself, but for control characters. Others are asked of the library's own
    expressions: which tables of Unicode it has doesn't matter. No stand-in makes a contraction.
    """
    points = np.array([*range(0x80, 0xD800), *range(0xE000, 0x110000)])
    text = "".join(map(chr, points.tolist()))

    def spans(pattern: str, text: str) -> list[tuple[int, int]]:
        return [at for _, at in pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str(text)]

    alike = spans(r"\p{L}+|\p{N}+|\s+", text)
    # Between marks that are of no class, what stands alone is a match.
    firsts = "!".join(text[low] for low, _ in alike)
    out = np.full(0x110000, ord("#"), np.uint8)
    out[0x20:0x80] = np.arange(0x20, 0x80)
    out[9:14] = ord("\t")
    for pattern, stand_in in ((r"\p{L}", "z"), (r"\p{N}", "0"), (r"\s", "\t")):
        for low, high in spans(pattern, firsts):
            if low % 2 == 0 and high == low + 1:
                a, b = alike[low // 2]
                out[points[a:b]] = ord(stand_in)
    return out


_NONE = np.int32(2**31 - 1)


class Merger:
    """The merges of one vocabulary, as arrays; small enough to send to every task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        if len(vocab) > 1 << 16:
            raise ValueError("only vocabularies of up to 65536 ids are supported")
        # Bytes that print stand for themselves, the others for the code points from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(prints))}
        self.byte_ids = np.array([vocab[stands[b]] for b in range(256)], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # The ranks by key: keys that fall together in one table go on to the next.
        self.tables: list[tuple[np.uint32, np.uint32, np.ndarray, np.ndarray]] = []
        left, rank = keys.astype(np.uint32), np.arange(len(keys), dtype=np.int32)
        bits = max(8, int(len(keys)).bit_length() + 4)
        while len(left):
            factor, shift = np.uint32(2654435761 + 2 * len(self.tables)), np.uint32(32 - bits)
            slot, first = np.unique(left * factor >> shift, return_index=True)
            at, value = np.zeros(1 << bits, np.uint32), np.full(1 << bits, _NONE, np.int32)
            at[slot], value[slot] = left[first], rank[first]
            self.tables.append((factor, shift, at, value))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, rank, bits = left[rest], rank[rest], max(8, bits - 4)
        self.stand_ins = stand_ins()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        out = np.full(len(key), _NONE, np.int32)
        for factor, shift, at, value in self.tables:
            slot = key * factor >> shift
            out = np.minimum(out, np.where(at[slot] == key, value[slot], _NONE))
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece's begin.

        Every round finds the lowest rank among each piece's neighbouring symbols and
        merges that pair wherever it stands in the piece, left to right; pieces without
        a known pair leave the round. A merge can't make a pair of lower rank, so this
        equals merging one pair at a time.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done_symbols, done_pieces = [], []
        while len(symbols):
            joined = piece[1:] == piece[:-1]
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1][joined] = self.ranks_of(symbols[:-1][joined], symbols[1:][joined])
            begins = np.flatnonzero(np.concatenate([[True], ~joined]))
            lowest = np.minimum.reduceat(rank, begins)
            lowest = np.repeat(lowest, np.diff(np.append(begins, len(symbols))))
            still = lowest != _NONE
            if not still.all():
                done_symbols.append(symbols[~still])
                done_pieces.append(piece[~still])
                symbols, piece, rank, lowest = symbols[still], piece[still], rank[still], lowest[still]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == lowest)
            # Of hits side by side (a run of one symbol) every second is taken.
            run = np.cumsum(np.concatenate([[True], np.diff(hit) != 1])) - 1
            place = np.arange(len(hit)) - np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))[run]
            hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        symbols = np.concatenate([*done_symbols, np.zeros(0, np.int32)])
        piece = np.concatenate([*done_pieces, np.zeros(0, np.int64)])
        order = np.argsort(piece, kind="stable")
        counts = np.bincount(piece, minlength=len(pieces))
        return symbols[order], np.concatenate([[0], np.cumsum(counts)])


def split(text: str, stand_ins: np.ndarray | None) -> list[str]:
    """The text cut where its stand-ins are; without a table, where it is itself."""
    if stand_ins is None:
        return _SPLIT.findall(text)
    shown = stand_ins[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes().decode("ascii")
    ends = np.cumsum([len(t) for t in _SPLIT.findall(shown)]).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pretokens(text: str, stand_ins: np.ndarray | None, special: dict[str, int]) -> list[str]:
    """The text's pre-tokens; a special string in it is one of its own, as the library has it by default."""
    if not any(mark in text for mark in special):
        return split(text, stand_ins)
    out: list[str] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text):
        out += [part] if part in special else split(part, stand_ins)
    return out


class Places(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts in a task: pre-tokens met lately keep theirs, new ones are merged together.

    What is kept is bounded: it begins anew once it holds more than `most` pre-tokens.
    """

    def __init__(self, merger: Merger, most: int = 200_000):
        self.merger, self.most = merger, most
        self._reset()

    def _reset(self) -> None:
        self.place = Places()
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Ids of the pre-tokens that have a place, but none yet."""
        known, special = len(self.begin) - 1, self.merger.special
        new = list(islice(reversed(self.place), len(self.place) - known))[::-1]
        if not new:
            return
        ids, begin = self.merger.encode([b"" if w in special else w.encode() for w in new])
        marks = [i for i, w in enumerate(new) if w in special]
        if marks:
            ids = np.insert(ids, begin[marks], [special[new[i]] for i in marks])
            begin = begin + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(new)), marks))])
        self.begin = np.concatenate([self.begin, begin[1:] + self.begin[-1]])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.most:
            self._reset()
        unusual = np.diff(np.searchsorted(np.flatnonzero(_UNUSUAL[data]), starts)) > 0
        tokens: list[str] = []
        ends = [0]
        for a, b, u in zip(starts[:-1].tolist(), starts[1:].tolist(), unusual.tolist(), strict=True):
            tokens += pretokens(data[a:b].tobytes().decode(), self.merger.stand_ins if u else None, self.merger.special)
            ends.append(len(tokens))
        at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        self._learn()
        return at, np.array(ends)

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many ids each text has; the texts' bytes are end to end."""
        at, ends = self._places(data, starts)
        total = np.concatenate([[0], np.cumsum(np.diff(self.begin)[at])])
        return total[ends[1:]] - total[ends[:-1]]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        at, ends = self._places(data, starts)
        sizes = np.diff(self.begin)[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.begin[at] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[source], total[ends]


def count_tokens(documents: DataFrame, vocabulary: str, max_tokens: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit (more than `max_tokens`) of every whole text.

    A null text counts as an empty one: 0 bytes, 0 tokens. Keys are passed on as they
    are, null and repeated ones too; other columns are not read. One map over the
    partitions, nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Merger(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for low, high, data, starts in texts_of(batch, "text", 1 << 20):
                n = encoder.counts(data, starts)
                yield pa.record_batch([column(batch, "key").slice(low, high - low), pa.array(np.diff(starts)), pa.array(n, pa.int64()), pa.array(n > max_tokens)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    chosen = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
