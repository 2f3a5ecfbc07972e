"""Retrieval over sparse and dense vectors, and reranking."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.remote import on_workers
from ..functions.vectors import dot, normalise
from . import index
from .phrases import checkpointed


def rank(run: DataFrame, k: int | None = None, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """``run`` with rank by (score descending, document); only the first k if given (pruned before the shuffle's sort)."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    out = run.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def impact_scores(queries: DataFrame, docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score): inner products over shared terms, above the threshold.

    queries: (query_id, term, weight); docs: (doc_id, term, weight).  Postings are dealt by document and meet the
    queries' terms where they lie (broadcast, if counted to be few), so the many products of a pair are summed
    without another shuffle.  More queries are joined by term, where AQE splits a hot term's postings, and
    partial sums are combined before the shuffle by (query, document).
    """
    asked = queries.select("query_id", "term", F.col("weight").alias("qw"))
    few = bounded(asked)
    pairs = (docs.repartition("doc_id") if few is not asked else docs).join(few, "term")
    return pairs.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score")).where(F.col("score") > threshold)


def explain_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The products that a score is the sum of."""
    pairs = queries.select("query_id", "term", F.col("weight").alias("qw")).join(docs, "term")
    return pairs.select("query_id", "doc_id", "term", (F.col("qw") * F.col("weight")).alias("product"))


def search(queries: DataFrame, docs: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    return rank(impact_scores(queries, docs, threshold), k)


def weigh(queries: DataFrame, is_phrase: Column, tokens: float = 1.0, phrases: float = 1.0) -> DataFrame:
    return queries.withColumn("weight", F.col("weight") * F.when(is_phrase, F.lit(phrases)).otherwise(F.lit(tokens)))


def gated_search(queries: DataFrame, docs: DataFrame, is_phrase: Column, k: int, gate: int, tokens: float = 1.0, phrases: float = 1.0) -> DataFrame:
    """Hits of the whole vectors, tokens and phrases weighed, that are also among the first ``gate`` hits of the phrase terms alone."""
    only = search(queries.where(is_phrase), docs, gate).select("query_id", "doc_id")
    return rank(impact_scores(weigh(queries, is_phrase, tokens, phrases), docs).join(only, ["query_id", "doc_id"], "left_semi"), k)


def indexed_gated_search(rows: DataFrame, queries: DataFrame, is_phrase: Column, k: int, gate: int, tokens: float = 1.0, phrases: float = 1.0) -> DataFrame:
    """``gated_search`` answered from an index.

    The phrase terms decide which documents each task hands on, ``gate`` a query at most; the whole score comes along
    as a second one, so no posting is read twice.
    """
    weighed = weigh(queries, is_phrase, tokens, phrases).withColumnRenamed("weight", "second")
    both = queries.select("query_id", "term", F.when(is_phrase, F.col("weight")).otherwise(F.lit(0.0)).alias("weight")).join(weighed, ["query_id", "term"])
    found = rank(index.search(rows, both, gate), gate)
    return rank(found.select("query_id", "doc_id", F.col("second").alias("score")), k)


#: Tokens of the texts that a worker counts at once; rows of a batch that it hands on.
COUNT_TOKENS, COUNT_ROWS = 1 << 20, 1 << 16


def count_batches(batches):
    """(key, term, tf) of batches (key, tokens), row by row."""
    for rows in batches:
        sizes = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < rows.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COUNT_TOKENS, side="right")))
            part = rows.slice(start, stop - start)
            coded = part.column(1).flatten().dictionary_encode()
            row = np.repeat(np.arange(part.num_rows), sizes[start:stop])
            keys, tf = np.unique(row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            for lo in range(0, len(keys), COUNT_ROWS):
                own = keys[lo : lo + COUNT_ROWS]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own // len(coded.dictionary))), coded.dictionary.take(pa.array(own % len(coded.dictionary))), pa.array(tf[lo : lo + COUNT_ROWS], pa.int64())], [rows.schema.names[0], "term", "tf"])
            start = stop


def one_row_each(rows: DataFrame, key: str) -> bool:
    """Whether no two rows have the same key (null is one); only keys travel."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def postings(texts: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) of the rows' tokens.

    Where each key has one row, its terms are counted there and nothing shuffles; else the rows of a key are one text.
    """
    if not one_row_each(texts, key):
        return texts.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    rows, kind = texts.select(key, tokens.alias("tokens")), texts.schema[key].dataType.simpleString()
    return rows.mapInArrow(on_workers(texts.sparkSession, __name__, "count_batches"), f"{key} {kind}, term string, tf long")


def corpus_statistics(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, term, tf), one row a document and term: (term, df, idf) and one row (n_docs, avg_len)."""
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.crossJoin(F.broadcast(corpus)).select("term", "df", idf.alias("idf")), corpus


def of_terms(postings: DataFrame, terms: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """``postings`` with the columns of ``terms``; only those of ``wanted`` (term), which are broadcast if they are few."""
    if wanted is None:
        return postings.join(terms, "term")
    known = checkpointed(terms.join(wanted.select("term").distinct(), "term", "left_semi"))
    return postings.join(bounded(known), "term")


def bm25_impacts(postings: DataFrame, k1: float = 0.9, b: float = 0.4, scale: int = 100, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight): whole-number BM25 term scores of (doc_id, term, tf).

    The corpus row (two numbers) is broadcast; term statistics join by term.  wanted: (term), to weigh those alone by the
    statistics of all, so that no other posting shuffles.
    """
    terms, corpus = corpus_statistics(postings)
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    rows = of_terms(postings, terms, wanted).join(lengths, "doc_id").crossJoin(F.broadcast(corpus))
    tf = F.col("tf")
    score = F.lit(scale) * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.select("doc_id", "term", F.floor(score).cast("long").alias("weight"))


def indexed_search(rows: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """``search`` answered from an index: lists of the queries' terms, block by block."""
    return rank(index.search(rows, queries, k, threshold), k)


def bm25_search(queries: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query (query_id, term, weight) by whole-number BM25 scores of (doc_id, tokens).

    The texts are indexed where they lie, in a scratch folder, by the queries' terms if they are few, and the index answers.
    """
    spark = tokens.sparkSession
    folder = index.scratch(spark)
    index.write_texts(tokens, folder, only=index.few_terms(queries))
    return rank(index.bm25_search(index.read(spark, folder), queries, k), k).withColumn("score", F.col("score").cast("long"))


def contained_in(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose text holds a passage's whole text.  passages: (query_id, text), docs: (doc_id, text).

    The words of a passage but for its first and last, which may begin or end within a word of the document, are
    words of any document that holds it.  So pairs meet by the longest of them and are then compared; passages of
    fewer than three words are compared with all documents.
    """
    words = F.split("text", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    own = passages.select("query_id", F.col("text").alias("_q"), F.when(F.size(inner) > 0, longest).alias("_w"))
    long_, short = own.where("_w IS NOT NULL"), own.where("_w IS NULL AND _q IS NOT NULL").drop("_w")
    # words leave their text behind; the few documents that hold such a word meet theirs again
    some = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("_w")).join(bounded(long_), "_w").select("query_id", "_q", F.col("doc_id").alias("_d"))
    met = docs.join(bounded(checkpointed(some)), F.col("doc_id").eqNullSafe(F.col("_d"))).where(F.contains("text", "_q")).select("query_id", "doc_id")
    rest = docs.join(bounded(short), F.contains("text", "_q")).select("query_id", "doc_id")
    return met.unionAll(rest).distinct()


#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 200_000


def bounded(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with a broadcast hint if they are counted to be few enough."""
    return F.broadcast(rows) if rows.count() <= most else rows


def okapi_scores(queries: DataFrame, postings: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 whose negative idf are replaced by epsilon times the mean idf; query terms count as often as they occur."""
    terms, corpus = corpus_statistics(postings)
    n = F.col("n_docs")
    raw = terms.drop("idf").crossJoin(F.broadcast(corpus)).select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    tf = F.col("tf")
    docs = of_terms(postings, idf, queries).join(lengths, "doc_id").crossJoin(F.broadcast(corpus))
    docs = docs.select("doc_id", "term", (F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("weight"))
    # the lengths' join leaves a document in one task, where few queries meet it and its pairs are summed
    return docs.join(bounded(queries.select("query_id", "term", F.col("tf").alias("qtf"))), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


#: Queries of a block that every task holds; pairs that a task scores at once.
QUERY_BLOCK, PAIRS_AT_ONCE = 4096, 1 << 20


def dense_search(queries: DataFrame, docs: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k documents of the largest cosine: (query_id, v) against (doc_id, v), a flat index.

    digits: cosines are rounded to so many before they are ranked, so that sums in another order tie.

    Each row of ``docs`` is read once and no vector shuffles: one block of queries goes to every task, which hands on its
    own k best a query (``dense_batches``).  More queries are dealt into blocks, and each block is joined with all
    documents under its number.
    """
    spark, whole = docs.sparkSession, lambda rows, key: rows.select(key, F.col("v").cast("array<double>").alias("v"))
    block = whole(queries, "query_id").limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    if block.num_rows <= QUERY_BLOCK:
        kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
        ids, vectors = (pa.concat_arrays(block[c].chunks) if block[c].num_chunks else pa.array([], block[c].type) for c in ("query_id", "v"))
        found = whole(docs, "doc_id").mapInArrow(on_workers(spark, __name__, "dense_batches", ids, vectors, k, digits), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
        return rank(found, k)
    q = queries.select("query_id", normalise(F.col("v")).alias("qv"))
    d = docs.select("doc_id", normalise(F.col("v")).alias("dv"))
    blocks = -(-q.count() // QUERY_BLOCK)
    dealt = d.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.join(q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "_block")
    score = dot(F.col("qv"), F.col("dv"))
    return rank(pairs.select("query_id", "doc_id", (score if digits is None else F.round(score, digits)).alias("score")), k)


def by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of length 1 by their number of components: places and matrix; under -1 the places of those that are null or hold nulls.

    Sums run from the first component to the last, as the expressions ``normalise`` and ``dot`` have them.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if vectors.flatten().null_count:
        sizes[pc.list_parent_indices(vectors).filter(pc.is_null(vectors.flatten())).to_numpy()] = -1
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) if n > 0 else np.zeros((len(at), 0))
        squares = np.zeros(len(at))
        for j in range(x.shape[1]):
            squares += x[:, j] * x[:, j]
        out[n] = at, x / (np.sqrt(squares) + 1e-9)[:, None]
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers rounded as Spark's ``round`` does, half away from zero by their shortest decimals."""
    out = x.copy()
    on = np.flatnonzero(np.isfinite(x))
    y = np.abs(x[on]) * 10.0**digits
    whole = np.floor(y)
    out[on] = np.copysign((whole + (y - whole >= 0.5)) / 10.0**digits, x[on]) + 0.0
    for i in on[(np.abs(y - whole - 0.5) <= 8 * np.spacing(y)) | (y >= 2**50)].tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400))) + 0.0
    return out


def dense_batches(batches, ids: pa.Array, vectors: pa.Array, k: int, digits: int | None):
    """(query_id, doc_id, score): each query's k best of one task's (doc_id, v), ties to the smaller id; null scores are last, NaN first.

    A matrix product finds which documents can be among the k best, within a margin that covers its last digits and
    the rounding; those alone are scored exactly.
    """
    asked = by_length(vectors)
    margin = 1e-9 + (0.0 if digits is None else 10.0**-digits)
    least = np.full(len(ids), -np.inf)
    # what is kept of all queries: query's place, kind (0 null, 1 number, 2 NaN), score, document
    query, kind, score, docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None
    step = max(k, PAIRS_AT_ONCE // max(len(ids), 1))
    with np.errstate(all="ignore"):
        for batch in batches:
            docs = batch.column(0).slice(0, 0) if docs is None else docs
            for lo in range(0, batch.num_rows if k else 0, step):
                rows = batch.slice(lo, step)
                found = []
                for n, (at, d) in by_length(rows.column(1)).items():
                    for m, (own, q) in asked.items():
                        if n != m or n < 0:  # no score: the smallest ids are enough
                            first = at[np.argsort(places(rows.column(0).take(pa.array(at))), kind="stable")[:k]]
                            found.append((np.repeat(own, len(first)), np.tile(first, len(own)), np.zeros(len(own) * len(first), np.int64), np.zeros(len(own) * len(first))))
                            continue
                        near = q @ d.T
                        if len(at) >= k:
                            cut = np.fmax(least[own], np.partition(near, len(at) - k, axis=1)[:, len(at) - k] - margin)
                        else:
                            cut = least[own]
                        i, j = np.nonzero(~(near < cut[:, None]))
                        exact = np.zeros(len(i))
                        for c in range(n):
                            exact += q[i, c] * d[j, c]
                        exact = exact if digits is None else half_up(exact, digits)
                        none = np.isnan(exact)
                        found.append((own[i], at[j], np.where(none, 2, 1), np.where(none, 0.0, exact)))
                new = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
                docs = pa.concat_arrays([docs, rows.column(0).take(pa.array(new[1]))])
                query, kind, score = (np.concatenate([a, b]) for a, b in zip((query, kind, score), (new[0], new[2], new[3])))
                order = np.lexsort((places(docs), -score, -kind, query))
                number = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                keep = order[number < k]
                full = order[(number == k - 1) & (kind[order] == 1) & np.isfinite(score[order])]
                least[query[full]] = score[full] - margin
                query, kind, score, docs = query[keep], kind[keep], score[keep], docs.take(pa.array(keep))
    if docs is not None:
        score = np.where(kind == 2, np.nan, score)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), docs, pa.array(score, pa.float64(), mask=kind == 0)], ["query_id", "doc_id", "score"])


def places(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, nulls first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def max_sim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Sum over a query's positions of the best matching document position.

    Both sides: (id, pos, term, weight); a pair of positions scores the inner product over shared terms.
    """
    q = queries.select("query_id", F.col("pos").alias("qpos"), "term", F.col("weight").alias("qw"))
    pairs = q.join(docs.select("doc_id", F.col("pos").alias("dpos"), "term", "weight"), "term")
    blocks = pairs.groupBy("query_id", "doc_id", "qpos", "dpos").agg(F.sum(F.col("qw") * F.col("weight")).alias("s"))
    return blocks.groupBy("query_id", "doc_id", "qpos").agg(F.max("s").alias("s")).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def preference_scores(pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of (query_id, a, b, s), where s says how much a is preferred in the pair (a, b).

    A win counts 1, a tie half.
    """
    back = pairs.select("query_id", F.col("a").alias("b"), F.col("b").alias("a"), F.col("s").alias("t"))
    both = pairs.join(back, ["query_id", "a", "b"])
    point = F.when(F.col("s") > F.col("t"), 1.0).when(F.col("s") == F.col("t"), 0.5).otherwise(0.0)
    return both.groupBy("query_id", F.col("a").alias("doc_id")).agg(F.sum(point).alias("score"))


def with_position_bonus(scores: DataFrame, run: DataFrame, bonus: float = 0.001) -> DataFrame:
    return scores.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"]).select("query_id", "doc_id", (F.col("score") + F.lit(bonus) / F.col("rank")).alias("score"))


def hard_negatives(run: DataFrame, own: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Each query's best hit that is not its own document (query_id, own_id) and shares no label with it.

    labels: (doc_id, labels array).
    """
    rows = run.join(own, "query_id").where("doc_id <> own_id")
    if labels is not None:
        mine = labels.select(F.col("doc_id").alias("own_id"), F.col("labels").alias("own_labels"))
        rows = rows.join(mine, "own_id").join(labels, "doc_id").where(~F.arrays_overlap("labels", "own_labels"))
    return rank(rows.select("query_id", "doc_id", "score"), 1).drop("rank")


def idf_gate(queries: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """Query terms whose idf (term, idf) is above ``least``; terms that no document has go."""
    return queries.join(terms.where(F.col("idf") > least).select("term"), "term", "left_semi")


def enough_matches(queries: DataFrame, docs: DataFrame, k: int, share: int = 5, most: int = 4) -> DataFrame:
    """Search that wants min(most, terms / share) of a query's terms in a document.

    Pairs shuffle once, by query, and are counted, ranked and cut where they lie; very many do so in passes (``index.met_in_passes``).
    """
    q = queries.select("query_id", "term", F.col("weight").alias("qw"))
    needs = q.groupBy("query_id").agg(F.least(F.lit(most), F.floor(F.count(F.lit(1)) / share)).alias("need")).transform(checkpointed)
    counted = lambda rows: rows.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("product").alias("score"))
    enough = lambda rows: counted(rows).join(needs, "query_id").where("n >= need").select("query_id", "doc_id", "score")
    return rank(index.met_in_passes(q, docs, enough, lambda rows: rank(rows, k).drop("rank"), (F.col("qw") * F.col("weight")).alias("product")), k)


def query_likelihood(pairs: DataFrame, queries: DataFrame, postings: DataFrame, dictionary: DataFrame | None = None, least: float = 1e-10) -> DataFrame:
    """(query_id, doc_id, likelihood): the mean over a query's distinct terms of occurrences times log(tf / length).

    pairs: (query_id, doc_id); queries: (query_id, term, tf); postings: (doc_id, term, tf).  A term that the document
    lacks has the probability ``least``.  dictionary: (term), without whose terms neither side has any; a query that
    is left without terms gives no row.
    """
    if dictionary is not None:
        known = dictionary.select("term").distinct()
        queries, postings = (x.join(known, "term", "left_semi") for x in (queries, postings))
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    asked = queries.select("query_id", "term", F.col("tf").alias("qtf"))
    rows = pairs.select("query_id", "doc_id").join(asked, "query_id").join(lengths, "doc_id", "left").join(postings, ["doc_id", "term"], "left")
    log = F.log(F.coalesce(F.col("tf") / F.col("len"), F.lit(least)))
    return rows.groupBy("query_id", "doc_id").agg((F.sum(F.col("qtf") * log) / F.count(F.lit(1))).alias("likelihood"))
