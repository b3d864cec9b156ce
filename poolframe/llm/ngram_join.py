"""Near duplicates by the Jaccard likeness of n-gram sets: a prefix-tree join.

An exact prefix filter says which documents may be linked, and gathers those in families.
Within a family the sets stand in a trie in one order of n-grams, and each set walks
down it with the overlap so far, leaving a subtree when what remains can't reach the
likeness asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolframe.llm.arrow import column, distinct_shingles, groups, mix64, segment_sums, texts_of
from poolframe.llm.components import components
from poolframe.llm.store import join_counted, stored, unused

#: Counters of the sketch of n-gram frequencies (the logarithm of their number), and how many go in a row.
BITS, CHUNK = 20, 1 << 12
#: Documents that share an n-gram are paired up to this number; beyond it they go to one family.
RUN = 100
#: n-grams that the sets of one block of a family hold together.
BLOCK = 1 << 17
#: Sets of a family that all of its blocks are compared with first, as long as these fit a quarter of a block.
STANDARDS = 32
#: Bytes of sets after which a task passes on what it has made for the blocks.
SHIP_BYTES = 1 << 22
#: Bits of the map of documents that a family may need.
FILTER_BITS = 1 << 25

_SIGN = np.uint64(0x5DEECE66D1234567)


class Likeness:
    """At least `part` / `of` of the union of two sets is in both."""

    def __init__(self, part: int = 75, of: int = 100):
        self.part, self.of = part, of

    def least_shared(self, n: np.ndarray) -> np.ndarray:
        """Of a set of n: how many any set that is like it shares with it at least."""
        return -(-self.part * n // self.of)

    def spare(self, n: np.ndarray) -> np.ndarray:
        """How many n-grams of the prefixes two sets share at least, if n is the smaller one's size."""
        return -(-n // 10)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many first n-grams of each of two like sets have spare(smaller) in common."""
        return np.minimum(n, n - self.least_shared(n) + self.spare(n))

    def holds(self, shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (self.part + self.of) * shared >= self.part * (n + m)

    def sizes_fit(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.of * np.minimum(n, m) >= self.part * np.maximum(n, m)


def set_ids(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 bits for each set, by which equal sets are known; null sets have 0."""
    return mix64(segment_sums(mix64(sets ^ _SIGN), begin) + np.diff(begin).astype(np.uint64)).astype(np.int64)


def _counter(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - BITS)).astype(np.int64)


def _describe(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id) of each document, and rows (chunk, counts) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << BITS, np.uint32)
        kind = pa.int64()
        for batch in batches:
            kind = column(batch, "doc_id").type
            for low, high, data, starts in texts_of(batch, "text"):
                sets, begin = distinct_shingles(data, starts, width)
                np.add.at(sketch, _counter(sets), np.uint32(1))
                n, none = np.diff(begin), pa.nulls(high - low)
                yield pa.record_batch(
                    [column(batch, "doc_id").slice(low, high - low), pa.array(n, pa.int64()), pa.array(set_ids(sets, begin), pa.int64(), mask=n == 0), none.cast(pa.int32()), none.cast(pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "chunk", "counts"],
                )
        rows = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(sketch.reshape(-1, CHUNK)) if c.any()]
        if not rows:
            return
        none = pa.nulls(len(rows))
        yield pa.record_batch(
            [none.cast(kind), none.cast(pa.int64()), none.cast(pa.int64()), pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["doc_id", "n_shingles", "set_id", "chunk", "counts"]
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return stored(documents.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_id bigint, chunk int, counts binary"), "shingles")


def _sketch(described: DataFrame) -> np.ndarray:
    """The sketch of all documents: 2**BITS numbers, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["chunk"]):
            total = np.zeros(CHUNK, np.int64)
            for counts in table["counts"].to_pylist():
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
            yield pa.record_batch([pa.array([table["chunk"][0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    rows = described.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, counts binary")
    total = np.zeros(1 << BITS, np.int64)
    for chunk, counts in rows.collect():
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(counts), np.int64)
    return total


def _ranks(sketch: np.ndarray) -> np.ndarray:
    """0 for a counter like most, else the order of magnitude of its count.

    This makes n-grams of common passages the last of each set. Any order gives the same
    links, so an estimate will do.
    """
    usual = sketch.mean()
    return np.where(sketch > usual + 8 * np.sqrt(usual) + 16, np.log2(np.maximum(sketch, 1)).astype(np.int8), np.int8(0))


def _entries(documents: DataFrame, ranks: np.ndarray, width: int, like: Likeness) -> DataFrame:
    """(key, other, size, place): n-gram and set for the prefix of each set.

    For n-grams of common passages set and n-gram change places: these rows
    are edges as they stand, and their key spreads them over all tasks; their size is negative.
    """
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, starts in texts_of(batch, "text"):
                sets, begin = distinct_shingles(data, starts, width)
                ids = set_ids(sets, begin)
                n = np.diff(begin)
                first = np.zeros(len(n), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                take = first & (n > 0) & ~np.isin(ids, seen)
                seen = np.union1d(seen, ids[take])
                text = np.repeat(np.arange(len(n)), n)
                sets, text = sets[take[text]], text[take[text]]
                rank = ranks[_counter(sets)]
                order = np.lexsort((sets, rank, text))
                sets, rank = sets[order], rank[order]
                start = np.concatenate([[0], np.cumsum(np.where(take, n, 0))])
                place = np.arange(len(sets)) - start[text]
                inside = place < like.prefix(n)[text]
                sets, rank, text, place = sets[inside], rank[inside], text[inside], place[inside]
                common = rank > 0
                token, own = sets.view(np.int64), ids[text]
                yield pa.record_batch(
                    [
                        pa.array(np.where(common, own, token)),
                        pa.array(np.where(common, token, own)),
                        pa.array(np.where(common, -n[text], n[text]).astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                    ],
                    names=["key", "other", "size", "place"],
                )

    return documents.mapInArrow(run, "key bigint, other bigint, size int, place int")


def _keyed(rows: DataFrame, per_key: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """`per_key` over all rows of some whole keys at a time, in order of key and other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [np.asarray(column(batch, c)) for c in ("key", "other", "size", "place")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            # The last key's rows may go on in the next batch.
            complete = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield per_key(*(x[:complete] for x in held))
            held = [x[complete:] for x in held]
        if held is not None:
            yield per_key(*held)

    return rows.repartition("key").sortWithinPartitions("key", "other").mapInArrow(run, schema)


def _candidates(entries: DataFrame, like: Likeness) -> DataFrame:
    """Edges (a, b) between sets, or sets and n-grams, such that like sets are connected.

    Like sets share spare() n-grams of their prefixes, so only sets remain of whose prefix
    so many are in others' too. Either one of a pair's n-grams is common or shared by more
    than RUN sets, and an edge leads from each set to that n-gram or to its first set, or
    all of them make a row of the pair, and their number tells.
    """
    shared = stored(_keyed(entries, _shared, "key bigint, other bigint, size int, place int"), "shared")
    own = F.when(F.col("size") < 0, F.col("key")).otherwise(F.col("other"))
    counted = shared.groupBy(own.alias("set_id")).agg(F.count("*").alias("n"), F.max(F.abs("size")).alias("size"))
    hopeful = counted.where(F.col("n") >= F.ceil(F.ceil(F.col("size") * like.part / like.of) / 10)).select("set_id")
    shared = shared.withColumn("set_id", own).join(hopeful, "set_id", "left_semi").drop("set_id")
    rows = _keyed(shared, lambda *x: _pairs(*x, like), "a bigint, b bigint, shared int, need int")
    paired = rows.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    return paired.where("shared >= need").select("a", "b")


def _distinct(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    return new


def _shared(key: np.ndarray, other: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Of the rows those of common n-grams and those of n-grams that several sets have, once each."""
    new = _distinct(key, other)
    key, other, size, place = key[new], other[new], size[new], place[new]
    common, several = size < 0, np.zeros(len(key), bool)
    several[1:] = key[1:] == key[:-1]
    several[:-1] |= several[1:]
    keep = common | several
    return pa.record_batch([pa.array(x[keep]) for x in (key, other, size, place)], names=["key", "other", "size", "place"])


def _pairs(token: np.ndarray, ids: np.ndarray, size: np.ndarray, place: np.ndarray, like: Likeness) -> pa.RecordBatch:
    """Pairs, and how many n-grams of their prefixes these rows show them to share."""
    common = size < 0
    a, b, need = [token[common]], [ids[common]], [np.zeros(int(common.sum()), np.int64)]
    token, ids, size, place = token[~common], ids[~common], size[~common].astype(np.int64), place[~common].astype(np.int64)
    if len(token):
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(begin, len(token)))
        spare = like.spare(size)
        for n in np.unique(length[(length > 1) & (length <= RUN)]).tolist():
            at = begin[length == n][:, None] + np.arange(n)
            one, two = np.triu_indices(n, 1)
            x, y = at[:, one].ravel(), at[:, two].ravel()
            fits = like.sizes_fit(size[x], size[y])
            x, y = x[fits], y[fits]
            most = np.minimum(place[x], place[y]) + 1 + np.minimum(size[x] - place[x], size[y] - place[y]) - 1
            fits = like.holds(most, size[x], size[y])
            x, y = x[fits], y[fits]
            a.append(ids[x])
            b.append(ids[y])
            need.append(np.minimum(spare[x], spare[y]))
        many = np.repeat(length > RUN, length)
        first = np.repeat(ids[begin], length)
        other = many & (ids != first)
        a.append(first[other])
        b.append(ids[other])
        need.append(np.zeros(int(other.sum()), np.int64))
    a, b, need = map(np.concatenate, (a, b, need))
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    at = np.flatnonzero(_distinct(a, b))
    shared = np.diff(np.append(at, len(a)))
    # A pair that needs no further evidence at one n-gram needs none at all.
    need = np.where(np.minimum.reduceat(need, at) == 0, 0, need[at]) if len(at) else need
    shared = np.where(need == 0, 1 << 20, shared)
    return pa.record_batch([pa.array(a[at]), pa.array(b[at]), pa.array(shared.astype(np.int32)), pa.array(need.astype(np.int32))], names=["a", "b", "shared", "need"])


class Trie:
    """Sets of numbers, each in ascending order, as paths from a root; nodes hold runs of numbers.

    Nodes are in arrays: where a run lies in `numbers`, the depth after it, the smallest
    and the largest set below, the set that ends there (or -1), and its children.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.numbers = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in order])]).astype(np.int64)
        low, high, depth, parent, ends = [0], [0], [0], [-1], [-1]
        path = [0]
        for k, i in enumerate(order):
            size = len(sets[i])
            shared = 0
            if k:
                before = sets[order[k - 1]]
                m = min(len(before), size)
                differ = np.flatnonzero(before[:m] != sets[i][:m])
                shared = int(differ[0]) if len(differ) else m
            while len(path) > 1 and depth[path[-2]] >= shared:
                path.pop()
            top = path[-1]
            if depth[top] > shared:
                # The node's run is split: a new node takes its first part.
                up = path[-2]
                new = len(low)
                cut = low[top] + shared - depth[up]
                low.append(low[top])
                high.append(cut)
                depth.append(shared)
                parent.append(up)
                ends.append(-1)
                low[top] = cut
                parent[top] = new
                path[-1] = new
                top = new
            new = len(low)
            low.append(int(starts[k]) + depth[top])
            high.append(int(starts[k]) + size)
            depth.append(size)
            parent.append(top)
            ends.append(i)
            path.append(new)
        self.low, self.high, self.depth, self.ends = (np.array(x, np.int64) for x in (low, high, depth, ends))
        parent = np.array(parent, np.int64)
        self.smallest = np.where(self.ends >= 0, self.depth, np.iinfo(np.int64).max)
        self.largest = np.where(self.ends >= 0, self.depth, 0)
        for node in np.argsort(-self.depth, kind="stable").tolist():
            up = parent[node]
            if up >= 0:
                self.smallest[up] = min(self.smallest[up], self.smallest[node])
                self.largest[up] = max(self.largest[up], self.largest[node])
        by = np.argsort(parent, kind="stable")
        self.children = by[1:]
        self.child_begin = np.searchsorted(parent[by[1:]], np.arange(len(low) + 1))

    def like(self, wanted: np.ndarray, mark: np.ndarray, like: Likeness) -> np.ndarray:
        """Which sets are like the one `wanted`; `mark` tells of each number whether it is in it."""
        nodes, shared, n, found = np.zeros(1, np.int64), np.zeros(1, np.int64), len(wanted), []
        while len(nodes):
            count = self.child_begin[nodes + 1] - self.child_begin[nodes]
            shared = np.repeat(shared, count)
            nodes = self.children[_ranges(self.child_begin[nodes], count)]
            if not len(nodes):
                break
            length = self.high[nodes] - self.low[nodes]
            hit = mark[self.numbers[_ranges(self.low[nodes], length)]]
            shared = shared + segment_sums(hit.astype(np.int64), np.concatenate([[0], np.cumsum(length)]))
            depth = self.depth[nodes]
            rest = n - np.searchsorted(wanted, self.numbers[self.high[nodes] - 1], "right")
            # Of the sizes below a node, the one that leaves most room for the likeness.
            size = np.clip(depth + rest, self.smallest[nodes], self.largest[nodes])
            hopeful = like.holds(shared + np.minimum(size - depth, rest), n, size)
            nodes, shared, depth = nodes[hopeful], shared[hopeful], depth[hopeful]
            at = self.ends[nodes]
            found.append(at[(at >= 0) & like.holds(shared, n, depth)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ranges(low: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = np.cumsum(length)
    return np.repeat(low - total + length, length) + np.arange(total[-1] if len(total) else 0)


def linked(indexed: list[np.ndarray], probes: list[np.ndarray] | None, like: Likeness) -> list[tuple[int, int]]:
    """Links between sets (sorted arrays), as few as connect what all links do.

    Within `indexed`, or between it and `probes`, whose numbers go on from it.
    """
    sets = indexed + (probes or [])
    numbers, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # n-grams that most sets hold come first, so near copies share long paths.
    rank = np.empty(len(numbers), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(numbers))
    parts = np.split(rank[place], np.cumsum([len(s) for s in sets])[:-1])
    sets = [np.sort(p) for p in parts]
    trie, mark = Trie(sets[: len(indexed)]), np.zeros(len(numbers), bool)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(indexed) if probes else 0, len(sets)):
        mark[sets[i]] = True
        for j in trie.like(sets[i], mark, like).tolist():
            x, y = top(i), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((i, j))
        mark[sets[i]] = False
    return out


def _only(documents: DataFrame, members: DataFrame) -> DataFrame:
    """The documents that may be members, by a bitmap of FILTER_BITS bits at hashes of their keys.

    It has FILTER_BITS / 32 rows at most, whatever the size of the corpus. It only saves
    shuffling texts: what it lets through by chance goes in the join with the members.
    """

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))

    def bit(place: Column) -> Column:
        return F.pow(F.lit(2.0), F.pmod(place, F.lit(32))).cast("bigint")

    at = place(F.col("member"))
    words = members.groupBy(F.floor(at / 32).alias("word")).agg(F.bit_or(bit(at)).alias("bits"))
    at = place(F.col("doc_id"))
    return documents.join(F.broadcast(words), F.floor(at / 32) == F.col("word")).where(F.col("bits").bitwiseAND(bit(at)) != 0).drop("word", "bits")


def _shipped(batches: Iterator[pa.RecordBatch], width: int, apart: bool) -> Iterator[pa.RecordBatch]:
    """Sets of texts for pairs of blocks: of block `own` with each of those from `low` to `high`.

    If not `apart`, for each of these blocks alone, as one of its own. A batch holds
    SHIP_BYTES of sets and one set more at most, however many blocks get a set.
    """
    kinds = {"family": pa.int64(), "one": pa.int32(), "two": pa.int32(), "own": pa.int32(), "set_id": pa.int64(), "body": pa.binary()}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        want, family, own, first, last = (np.asarray(column(batch, c)) for c in ("set_id", "family", "own", "low", "high"))
        for low, high, data, starts in texts_of(batch, "text"):
            sets, begin = distinct_shingles(data, starts, width)
            ids = set_ids(sets, begin)
            for i in np.flatnonzero(ids == want[low:high]).tolist():
                body, mine = sets[begin[i] : begin[i + 1]].tobytes(), int(own[low + i])
                for j in range(int(first[low + i]), int(last[low + i])):
                    rows.append((int(family[low + i]), min(mine, j) if apart else j, max(mine, j) if apart else j, mine if apart else j, int(ids[i]), body))
                    held += len(body)
                    if held >= SHIP_BYTES:
                        yield made(rows)
                        rows, held = [], 0
    if rows:
        yield made(rows)


def _blocks_of(n: Column, sets: Column) -> Column:
    """How many blocks so many n-grams of so many sets make: of BLOCK n-grams, or two sets."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / F.lit(BLOCK)), F.ceil(sets / F.lit(2)))).cast("int")


def _placed(members: DataFrame) -> DataFrame:
    """Blocks for members (doc_id, set_id, n, family) of families of several: own, and low to high where they go.

    Each goes to one block, but for a few standards of a family of several blocks, which go
    to all: an n-gram in four of a block is theirs at most, or one set is.
    """
    draw = F.xxhash64("set_id", F.lit(1))
    families = members.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("sets"), F.min_by("set_id", draw).alias("standard")).where("sets > 1")
    families = families.select("family", "sets", "standard", _blocks_of(F.col("total"), F.col("sets")).alias("blocks"), F.least(F.lit(STANDARDS), F.floor(F.lit(BLOCK / 4) * F.col("sets") / F.col("total"))).alias("most"))
    own = F.pmod(F.col("set_id"), F.col("blocks")).cast("int")
    every = (F.col("set_id") == F.col("standard")) | (F.pmod(draw, F.col("sets")) < F.col("most"))
    placed = members.join(families, "family").withColumn("own", own)
    return placed.select("doc_id", "set_id", "n", "family", "blocks", "own", F.when(every, F.lit(0)).otherwise(F.col("own")).alias("low"), F.when(every, F.col("blocks")).otherwise(F.col("own") + 1).alias("high"))


def _placed_again(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks for what the first comparison leaves open: members of families that are in several classes.

    classes has (node, label). Members of one class are connected, so those of a family's
    largest class meet the family's others only, and these meet all.
    """
    several = placed.where("blocks > 1").select("doc_id", "set_id", "n", "family")
    classed = several.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("class", F.coalesce("label", "set_id")).drop("label")
    sizes = classed.groupBy("family", "class").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    families = sizes.groupBy("family").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class", "sets")).alias("main"), F.sum("n").alias("n"), F.sum("sets").alias("sets")).where("classes > 1")
    families = families.select(
        "family",
        F.col("main.class").alias("main"),
        _blocks_of(F.col("main.n"), F.col("main.sets")).alias("mains"),
        _blocks_of(F.col("n") - F.col("main.n"), F.col("sets") - F.col("main.sets")).alias("others"),
    )
    is_main = F.col("class") == F.col("main")
    own = F.when(is_main, F.col("others") + F.pmod(F.col("set_id"), F.col("mains"))).otherwise(F.pmod(F.col("set_id"), F.col("others"))).cast("int")
    high = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    return classed.join(families, "family").select("doc_id", "set_id", "family", own.alias("own"), F.lit(0).alias("low"), high.cast("int").alias("high"))


def _links(documents: DataFrame, placed: DataFrame, width: int, like: Likeness, apart: bool) -> DataFrame:
    """Links (a, b) between the sets that meet in blocks or, if `apart`, in pairs of blocks."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shipped(batches, width, apart)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for table in groups(batches, ["family", "one", "two"]):
            ids, own, body = table["set_id"].to_pylist(), table["own"].to_pylist(), table["body"].to_pylist()
            one, two = table["one"][0].as_py(), table["two"][0].as_py()
            first = [i for i in range(len(ids)) if own[i] == one]
            second = [i for i in range(len(ids)) if own[i] == two] if two != one else []
            if (two != one and not second) or not first:
                continue
            arrays = [np.frombuffer(x, np.uint64) for x in body]
            names = [ids[i] for i in first + second]
            for i, j in linked([arrays[i] for i in first], [arrays[i] for i in second] or None, like):
                a.append(names[i])
                b.append(names[j])
            if len(a) > 10_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    members = placed.withColumnRenamed("doc_id", "member")
    texts = _only(documents, members).join(members, F.col("doc_id").eqNullSafe(F.col("member"))).select("text", "set_id", "family", "own", "low", "high")
    blocks = texts.mapInArrow(ship, "family bigint, one int, two int, own int, set_id bigint, body binary")
    # A text may be there more than once where a key is.
    return blocks.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "set_id").mapInArrow(join, "a bigint, b bigint")


def _connected(documents: DataFrame, members: DataFrame, width: int, like: Likeness) -> DataFrame:
    """(node, label) for the sets of families that are linked with others; members has (doc_id, set_id, n, family)."""
    placed = stored(_placed(members), "placed")
    classes = components(_links(documents, placed, width, like, False))
    rest = stored(_placed_again(placed, classes), "rest")
    if rest.isEmpty():
        return classes
    across = _links(documents, rest, width, like, True)
    return components(across.unionByName(classes.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def join_groups(documents: DataFrame, width: int = 5, part: int = 75, of: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row (doc_id, n_shingles, set_id, component_id) per document.

    A document's set is that of its distinct `width`-word shingles (words are runs of
    bytes other than ASCII white space, A-Z lower-cased); one of fewer words has its
    sequence as a single shingle, one without words or a null text the empty set, which is
    linked with nothing. Two documents are linked when of * |both| >= part * |either|.
    `component_id` is the smallest key that a document is connected with, its own
    included. No link is lost: copies of a set are one node, and links of a family leave out
    only those between sets that are connected already. Shingles and sets are told apart by
    64-bit hashes. Repeated keys are documents of their own that answer to one key; a null
    key counts only where nothing else is connected. Other columns are not read. No
    documents give no rows.
    """
    like = Likeness(part, of)
    slim = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    described = _describe(slim, width)
    sets = described.where("chunk IS NULL").select("doc_id", "n_shingles", "set_id")
    entries = _entries(slim.select("text"), _ranks(_sketch(described)), width, like)
    families = components(_candidates(entries, like))
    nodes = stored(sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "nodes")
    members = nodes.drop("copies").join(families.withColumnRenamed("node", "set_id").withColumnRenamed("label", "family"), "set_id")
    found = _connected(slim, stored(members, "members"), width, like).withColumnRenamed("node", "set_id")
    # A class may have very many sets, and a set very many documents.
    classes = stored(nodes.join(found, "set_id", "left").select("set_id", "doc_id", "copies", F.coalesce("label", "set_id").alias("class")), "classes")
    smallest = stored(classes.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets")), "smallest")
    labelled = stored(join_counted(classes, smallest, "class", "sets", classes.count()).select("set_id", "copies", "component_id"), "labelled")
    joined = join_counted(sets, labelled, "set_id", "copies", sets.count())
    return joined.select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(documents: DataFrame, width: int = 5, part: int = 75, of: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near duplicates: of each component that one stays whose key is smallest.

    Documents without words all stay, and so do rows without a key. Rows of one key stay
    or go together.
    """
    gone = unused("gone", documents)
    losers = join_groups(documents, width, part, of, text, key).where("set_id IS NOT NULL AND doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(losers, documents[key] == losers[gone], "left_anti")
