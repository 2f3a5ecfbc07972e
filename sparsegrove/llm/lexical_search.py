"""Ranked lexical search by best-first branch and bound over hierarchical max trees.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, found on whole UTF-8
bytes in numpy and named by 64-bit hashes.  ``index_documents`` reads each text once and keeps a document's length and
its terms with their occurrences; it knows nothing of the queries, so one index answers many.  From it come the
counts over all documents, by sums that are combined before they shuffle, and the weights of the queries' terms.

A search task works through its part of the index in segments of ``SEGMENT`` documents.  For each asked term a segment
has a max tree: leaves are ranges of ``FANOUT`` documents, each node holds the largest impact of the term among the
documents below it.  A query's bound for a node is the sum over its terms of weight times node value.  The search opens
the node of highest bound first, replaces it by its children, and scores the documents of a leaf exactly; it ends where
the highest bound left is below the k-th score.  A node whose bound equals that score is opened too, for a
document of the same score and a smaller id may lie below.  The k best found carry over to the task's next segment, so
later segments mostly fall at their roots.  Tasks hand k rows a query to a rank by query.

Queries travel in blocks of ``BLOCK_TERMS`` terms (or one query, if it alone has more), each of which is one closure; more
queries are more blocks, never a larger one.  The index isn't shuffled.  With p partitions and q queries, k * p * q rows
shuffle at most.

Defined cases: a null text has no terms; rows without an id take no part; rows that repeat an id are documents of
their own; rows of ``items`` with one id are one query.  Items or documents without terms give no rows.  A very long text is
tokenised as a block of its own.  Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, batch, blocks, lowered, on_workers, raw, shared_checkpoint

FANOUT = 16
#: Documents of a segment: three levels of nodes.
SEGMENT = FANOUT**3
#: Terms of a block of queries, repeats counted.
BLOCK_TERMS = 1 << 15

POSTINGS = [("n", pa.int64()), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64()))]


def term_bytes(data: np.ndarray) -> np.ndarray:
    """The bytes, A-Z lower-cased, with a space for each that is no part of a term."""
    low = lowered(data)
    solid = (low >= 128) | ((low - 97) < 26) | ((low - 48) < 10)  # the bytes are unsigned and wrap around
    return np.where(solid, low, np.uint8(32))


def tokenise(batches):
    """(id, n, terms, tfs) of each row of (id, text) that has a term: distinct terms by name, with occurrences."""
    for rows in batches:
        schema = pa.schema([("id", rows.schema.field(0).type), *POSTINGS])
        for start, stop in blocks(rows.column(1)):
            words = Words(*(lambda data, offsets: (term_bytes(data), offsets))(*raw(rows.column(1)[start:stop])))
            counts = words.counts
            have = np.flatnonzero(counts)
            if not len(have):
                continue
            names, place = np.unique(words.hashes(), return_inverse=True)
            keys, tfs = np.unique(words.doc * len(names) + place, return_counts=True)
            doc, term = keys // len(names), names[keys % len(names)].view(np.int64)
            ends = np.append(np.searchsorted(doc, have), len(doc)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (term, tfs)]
            yield batch(schema, rows.column(0)[start:stop].take(pa.array(have)), counts[have], *lists)


def index_documents(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, n, terms, tfs): one row a document that has an id and a term, written once to the shared folder."""
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    return shared_checkpoint(rows.mapInArrow(on_workers(__name__, "tokenise"), f"id {kind}, n long, terms array<long>, tfs array<long>"))


def ask(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """(item_id, term, weight) of the items' terms that occur in documents; how many documents and terms there are."""
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    terms = asked.select(F.col("id").alias("item_id"), F.explode("terms").alias("term")).distinct()
    return terms.join(df, "term").select("item_id", "term", weight.cast("long").alias("weight")).where("weight > 0"), n_docs, n_terms


class Segment:
    """Documents by id, each with asked terms, their postings, and the max tree of each such term, level by level.

    levels[l][t, j] is the largest impact of term t among the documents of node j of level l; level 0 is the root, a node
    of the last level holds FANOUT documents.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_asked: int):
        self.ids = ids
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.present = np.unique(term)
        self.local = np.full(n_asked, -1, np.int64)
        self.local[self.present] = np.arange(len(self.present))
        self.term, self.impact = self.local[term], impact
        nodes = -(-len(ids) // FANOUT)
        lowest = np.zeros((len(self.present), nodes), np.int64)
        at = self.term * nodes + doc // FANOUT
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        lowest.flat[at[starts]] = np.maximum.reduceat(impact[order], starts)
        self.levels = [lowest]
        while self.levels[0].shape[1] > 1:
            below = self.levels[0]
            self.levels.insert(0, np.maximum.reduceat(below, np.arange(0, below.shape[1], FANOUT), axis=1))
        self.weights = np.zeros(len(self.present), np.int64)
        self.opened = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Enter the documents that belong to the k best into ``best``, a heap of (score, -id)."""
        rows = self.local[terms]
        here = rows >= 0
        rows, weights = rows[here], weights[here]
        if not len(rows):
            return
        self.weights[rows] = weights
        open_nodes = [(-int(weights @ self.levels[0][rows, 0]), 0, 0)]
        while open_nodes:
            bound, level, node = heappop(open_nodes)
            if len(best) == k and -bound < best[0][0]:
                break
            self.opened += 1
            low = node * FANOUT
            if level + 1 < len(self.levels):
                bounds = weights @ self.levels[level + 1][rows, low : low + FANOUT]
                least = best[0][0] if len(best) == k else 1
                for child in np.flatnonzero(bounds >= least).tolist():
                    heappush(open_nodes, (-int(bounds[child]), level + 1, low + child))
            else:
                self.score_leaf(low, min(low + FANOUT, len(self.ids)), k, best)
        self.weights[rows] = 0

    def score_leaf(self, low: int, high: int, k: int, best: list[tuple[int, int]]) -> None:
        a, b = self.first[low], self.first[high]
        scores = np.add.reduceat(self.weights[self.term[a:b]] * self.impact[a:b], self.first[low:high] - a)
        for j in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
            entry = int(scores[j]), -int(self.ids[low + j])
            if len(best) < k:
                heappush(best, entry)
            else:
                heappushpop(best, entry)


def segments(rows: pa.RecordBatch, names: np.ndarray, n_docs: int, n_terms: int):
    """The documents of a batch that hold an asked term, by id, in segments."""
    ids, n = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
    sizes = np.diff(rows.column(2).offsets.to_numpy())
    doc = np.repeat(np.argsort(np.argsort(ids, kind="stable"), kind="stable"), sizes)  # each document's place by id
    term = rows.column(2).flatten().to_numpy(zero_copy_only=False).view(U64)
    place = np.minimum(np.searchsorted(names, term), len(names) - 1)
    on = names[place] == term
    doc, term, tf = doc[on], place[on], rows.column(3).flatten().to_numpy(zero_copy_only=False)[on]
    order = np.argsort(doc, kind="stable")
    doc, term, tf = doc[order], term[order], tf[order]
    by_id = np.argsort(ids, kind="stable")
    ids, n = ids[by_id], n[by_id]
    held, doc = np.unique(doc, return_inverse=True)
    ids, n = ids[held], n[held]
    length = 50 + (50 * n * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * length[doc])
    for low in range(0, len(ids), SEGMENT):
        a, b = np.searchsorted(doc, [low, low + SEGMENT])
        yield Segment(ids[low : low + SEGMENT], doc[a:b] - low, term[a:b], impact[a:b], len(names))


def search_batches(batches, items: pa.Array, first: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Each query's k best documents of one part of the index."""
    names, place = np.unique(terms, return_inverse=True)
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(items))]
    for rows in batches:
        for segment in segments(rows, names, n_docs, n_terms):
            for q, heap in enumerate(best):
                own = slice(first[q], first[q + 1])
                segment.search(place[own], weights[own], k, heap)
    query = np.repeat(np.arange(len(items)), [len(heap) for heap in best])
    found = [entry for heap in best for entry in heap]
    yield pa.RecordBatch.from_arrays([items.take(pa.array(query)), pa.array([-i for _, i in found], pa.int64()), pa.array([s for s, _ in found], pa.int64())], ["item_id", "doc_id", "score"])


def query_blocks(asked: DataFrame):
    """The items' terms in blocks that are each small enough for a closure: items, offsets, names and weights."""
    asked = shared_checkpoint(asked)
    parts = max(1, -(-asked.count() // BLOCK_TERMS))
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "term").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        codes = rows["item_id"].combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.chunk(0)
        at = codes.indices.to_numpy()
        first = np.searchsorted(at, np.arange(len(codes.dictionary) + 1))
        yield codes.dictionary, first, rows["term"].to_numpy().view(U64), rows["weight"].to_numpy()


def search(index: DataFrame, items: DataFrame, k: int = 50, key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of an index, equal scores by ascending doc_id."""
    asked, n_docs, n_terms = ask(index, index_documents(items, key))
    kind = asked.schema["item_id"].dataType.simpleString()
    out = f"item_id {kind}, doc_id long, score long"
    rows = index.select(F.col("id").cast("long").alias("id"), "n", "terms", "tfs")
    found = items.sparkSession.createDataFrame([], out)
    for block in query_blocks(asked):
        found = found.unionAll(rows.mapInArrow(on_workers(__name__, "search_batches", *block, n_docs, n_terms, k), out))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 50) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {low}), '{pattern}') AS terms FROM documents WHERE doc_id IS NOT NULL),
held AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {low}), '{pattern}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN df USING (term), totals),
scored AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN held USING (r), totals GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored JOIN held USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
