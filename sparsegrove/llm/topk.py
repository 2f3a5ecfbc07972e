"""Exact top-k inner products by MaxScore over sharded postings.

Vectors become integers, floor(scale * x).  A dimension holds two terms, its positive and its negative
values; a query's component draws on the term of its own sign, whose products can only raise a score, while
the other term's can only lower it.  A shard's rows lie in strips; in each strip a term has a posting list (rows
and impacts) and a bound, its largest impact, which times the query's weight is the most the term can add there.

For each query and strip the terms are ordered by bound.  While the bounds of the terms left sum to less than the
query's threshold, a vector that occurs in those terms alone can't enter: they are non-essential, the others
essential.  The essential postings are traversed, adding up scores; the non-essential terms are probed only for
rows whose score so far plus the bounds left can still reach the threshold (reach, not exceed: ties go to the
smaller id).  Negative products are bounded by nought until the whole product is taken for the rows that are
left, so no vector that belongs to the answer is ever dropped.

A task reads its part of the vectors once, where they lie, in shards of ``SHARD_ROWS``; no vector shuffles.  The k-th
score that a query has found in one strip is its threshold in the next, within a shard and from shard to shard, so later
shards yield few candidates.  Each task hands on k rows a query, which a rank over (query, rows of all tasks) merges.  The
queries travel in the functions' closures, in blocks of ``BLOCK_QUERIES``: more queries are more blocks, each of which
reads the vectors once.

With p parts of the table and m queries, k * p * m rows shuffle at most.

Null or empty ids take no part; an empty vector (which holds nothing bad) scores 0 with all.  A repeated id stands
for as many candidates; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import on_workers

SCALE = 1024
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
#: Vectors scored at a time: the threshold found on one block prunes the next.
STRIP = 2048


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): whole-number components; a vector that is null or holds a null or non-finite value goes.

    Vectors of another length than most still score: the inner product runs over the shared components.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.where(~bad).select("vec_id", F.transform(x, lambda v: F.floor(v * F.lit(scale))).alias("q"))


def matrix(column) -> np.ndarray:
    """A list column as a dense matrix; missing components are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Strip:
    """Some rows of a shard: ids, components (dimension by dimension), and each signed term's posting list and bound."""

    def __init__(self, ids: np.ndarray, by_dim: np.ndarray):
        self.ids, self.by_dim = ids, by_dim
        self.postings = {}
        self.bounds = np.zeros((2, len(by_dim)), np.int64)
        for d, column in enumerate(by_dim):
            for sign, rows in ((0, np.flatnonzero(column > 0)), (1, np.flatnonzero(column < 0))):
                impacts = np.abs(column[rows])
                self.postings[sign, d] = rows, impacts
                self.bounds[sign, d] = impacts.max(initial=0)

    def search(self, query: np.ndarray, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can reach the threshold (all without one), and their scores."""
        width = min(len(query), len(self.by_dim))
        query = query[:width]
        weight, sign = np.abs(query), (query < 0).astype(np.int64)
        bound = weight * self.bounds[sign, np.arange(width)]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # left[j]: the most that the terms from the j-th on can add
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        if threshold is None:
            rows = np.arange(len(self.ids))
            return rows, query @ self.by_dim[:width]
        if left[0] < threshold:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # essential: up to where the rest alone can't reach the threshold
        essential = int(np.searchsorted(-left, -threshold, side="right"))
        gain = np.zeros(len(self.ids), np.int64)
        for d in order[:essential].tolist():
            at, impacts = self.postings[sign[d], d]
            gain[at] += impacts * weight[d]
        rows = np.flatnonzero(gain + left[min(essential, len(order))] >= threshold)
        gain = gain[rows]
        for j, d in enumerate(order[essential:].tolist(), essential):
            if not len(rows):
                break
            gain += np.maximum(self.by_dim[d][rows] * query[d], 0)
            on = gain + left[j + 1] >= threshold
            if not on.all():
                rows, gain = rows[on], gain[on]
        score = query @ self.by_dim[:width, rows]
        on = score >= threshold
        return rows[on], score[on]


def strips(ids: np.ndarray, q: np.ndarray) -> list[Strip]:
    """A shard's vectors in strips, by id."""
    order = np.argsort(ids, kind="stable")
    ids, by_dim = ids[order], np.ascontiguousarray(q[order].T)
    return [Strip(ids[a : a + STRIP], np.ascontiguousarray(by_dim[:, a : a + STRIP])) for a in range(0, len(ids), STRIP)]


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_batches(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best others among the vectors (vec_id, q) of one task, ties to the smaller id."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
    for rows in batches:
        for start in range(0, rows.num_rows, SHARD_ROWS):
            part = rows.slice(start, SHARD_ROWS)
            for strip in strips(part.column(0).to_numpy(zero_copy_only=False), matrix(pa.chunked_array([part.column(1)]))):
                for j, (query_id, query) in enumerate(zip(query_ids.tolist(), queries)):
                    best_s, best_i = best[j]
                    found, score = strip.search(query, int(best_s[-1]) if len(best_s) == k else None)
                    mine = strip.ids[found]
                    on = mine != query_id
                    if on.any():
                        s, i = np.concatenate([best_s, score[on]]), np.concatenate([best_i, mine[on]])
                        top = np.lexsort((i, -s))[:k]
                        best[j] = s[top], i[top]
    sizes = [len(s) for s, _ in best]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes), pa.int64()), pa.array(join([i for _, i in best]), pa.int64()), pa.array(join([s for s, _ in best]), pa.int64())], schema=OUT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) its k best rows of ``vectors`` but itself.

    A vec_id that is repeated stands for as many candidates.  Counting the queries, which reads no vector, sets the number of
    their blocks; one block at a time passes the driver.
    """
    rows, asked = quantise(vectors, scale), quantise(queries, scale)
    parts = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = None
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) == part).toArrow().sort_by("vec_id")
        if not block.num_rows:
            continue
        own = rows.mapInArrow(on_workers(__name__, "search_batches", block["vec_id"].to_numpy(), matrix(block["q"]), k), "query_id long, vec_id long, score long")
        found = own if found is None else found.unionAll(own)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, scale: int = SCALE, divisor: int = 100) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST({scale} AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % {divisor} = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
