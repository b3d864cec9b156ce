"""Exact search for the vectors of the highest inner product with each query, term at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolframe.llm.store import stored

#: Queries in a block, and vectors whose scores a dense array holds at a time.
QUERIES, CANDIDATES = 1024, 4096
#: Blocks of queries and rows of CANDIDATES vectors that meet in one key of the join.
BLOCKS, ROWS = 16, 16
#: Blocks whose best a task holds before it passes them on.
HELD = 64


def weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, null where one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def accumulate(query: list[np.ndarray], vectors: list[np.ndarray]) -> np.ndarray:
    """Inner products of all queries with all vectors, from one term's postings after the other."""
    scores = np.zeros((len(query), len(vectors)), np.int64)

    def postings(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.concatenate([np.arange(len(r)) for r in rows]) if rows else np.zeros(0, np.int64)
        value = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        some = value != 0
        order = np.argsort(term[some], kind="stable")
        return term[some][order], row[some][order], value[some][order]

    q_term, q_row, weight = postings(query)
    v_term, v_row, value = postings(vectors)
    for term in np.intersect1d(q_term, v_term).tolist():
        q = slice(*np.searchsorted(q_term, [term, term + 1]))
        v = slice(*np.searchsorted(v_term, [term, term + 1]))
        if v.stop - v.start == len(vectors):
            scores[q_row[q]] += weight[q, None] * value[v]
        else:
            scores[np.ix_(q_row[q], v_row[v])] += weight[q, None] * value[v]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best allowed scores, of equal ones those of smaller ids."""
    low = np.iinfo(np.int64).min
    scores = np.where(allowed, scores, low)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, at = np.nonzero((scores >= least[:, None]) & allowed)
    else:
        row, at = np.nonzero(allowed)
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The `k` vectors of highest score for each row that meets `queries`: query_id, rank, vec_id, score.

    Scores are inner products of floor(scale * x); vectors of unequal lengths are as if
    padded with 0. All rows but those of the query's own key are candidates; of equal scores
    the smaller key comes first; fewer candidates give fewer rows. Vectors that are null,
    hold nulls or numbers that aren't finite, and rows without a key take no part. Of
    queries with one key, that with the smallest vector is asked. Products must fit into
    64 bits.

    Blocks of queries and rows of vectors are dealt to groups and slices of fixed sizes, and each group meets
    each slice under a key of its own: so no key holds more than BLOCKS * QUERIES queries and about ROWS * CANDIDATES
    vectors, vectors are copied once for each group, queries once for each slice. A task keeps the best of
    each query so far, so k rows per query and task are all that is merged.
    """
    rows = vectors.select(vectors[key].cast("bigint").alias("id"), weights(vectors[vector], scale).alias("w"), queries.alias("asks")).where("id IS NOT NULL AND w IS NOT NULL")
    asked = rows.where("asks").groupBy("id").agg(F.min("w").alias("w"))
    n = asked.count()
    blocks = max(1, -(-n // QUERIES))
    groups, total = -(-blocks // BLOCKS), rows.count()
    slices = max(1, -(-total // (ROWS * CANDIDATES)))
    asked = stored(
        asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "w")).alias("queries")).select("block", F.col("queries.id").alias("query_ids"), F.col("queries.w").alias("query_weights")),
        "queries",
    )
    asked = asked.withColumns({"group": F.pmod("block", F.lit(groups)), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for up to CANDIDATES vectors."""
        for batch in batches:
            for low in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(low, CANDIDATES)
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.list_(pa.int64())))], names=["ids", "weights"])

    packed = rows.select("id", "w").mapInArrow(pack, "ids array<bigint>, weights array<array<bigint>>")
    sliced = packed.withColumns({"slice": F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(slices)).cast("int"), "group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    met = sliced.join(asked, ["group", "slice"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, w, query_ids, query_w = (batch.column(batch.schema.get_field_index(c))[r] for c in ("block", "ids", "weights", "query_ids", "query_weights"))
                ids, query_ids = ids.values.to_numpy(), query_ids.values.to_numpy()
                scores = accumulate(_lists(query_w), _lists(w))
                row, at = best(scores, ids, ids[None, :] != query_ids[:, None], k)
                new = (query_ids[row], ids[at], scores[row, at])
                if block.as_py() in kept:
                    new = tuple(np.concatenate(x) for x in zip(kept[block.as_py()], new, strict=True))
                    order = np.lexsort((new[1], -new[2], new[0]))
                    new = tuple(x[order] for x in new)
                    place = np.arange(len(order)) - np.searchsorted(new[0], new[0])
                    new = tuple(x[place < k] for x in new)
                kept[block.as_py()] = new
                if len(kept) >= HELD:
                    yield from passed_on(kept)
                    kept.clear()
        yield from passed_on(kept)

    def passed_on(kept: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for q, v, s in kept.values():
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    ranked = met.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lists(column: pa.Scalar) -> list[np.ndarray]:
    inner = column.values
    flat, offsets = inner.values.to_numpy(), inner.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
