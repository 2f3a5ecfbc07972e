"""Queries over the driver's tables, each an operator (or a few) with the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluation as E
from ..operators import index, max_sim
from ..operators import overlap as O
from ..operators import phrases as P
from ..operators import retrieval as R
from ..operators import sparse as S
from ..operators import training as N
from ..operators.retrieval import bounded
from . import fixtures as X
from .fixtures import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# sparse retrieval


def benchmark_queries(spark, d):
    return X.postings(spark, d, "benchmark", "item_id", "query_id").select("query_id", "term", F.lit(1).alias("weight"))


def bm25_run(spark, d, k=10):
    docs = X.texts(spark, d).select("doc_id", T.search_tokens(F.col("text")).alias("tokens"))
    return R.bm25_search(benchmark_queries(spark, d), docs, k)


@query(f"WITH {X.SQL_RUN} SELECT query_id, doc_id, score, rank FROM r")
def bm25_topk(spark, d):
    return bm25_run(spark, d)


def qrels(spark, d):
    held = R.contained_in(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), X.texts(spark, d))
    return held.select("query_id", "doc_id", (F.lit(1) + F.col("doc_id") % 2).cast("int").alias("rel"))


_EVAL = f"""WITH {X.SQL_RUN}, {X.SQL_QRELS}, i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM j),
ideal AS (SELECT query_id, sum(CASE WHEN n <= 10 THEN rel / log2(n + 1) ELSE 0 END) AS ideal, count(*) AS n_rel FROM i GROUP BY query_id),
x AS (SELECT r.query_id, r.rank, coalesce(j.rel, 0) AS rel FROM r LEFT JOIN j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE r.query_id IN (SELECT query_id FROM j)),
y AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM x),
z AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN rel > 0 THEN seen / rank ELSE 0 END) AS ap, min(CASE WHEN rel > 0 THEN rank END) AS first FROM y GROUP BY query_id),
v AS (SELECT z.query_id, dcg / ideal AS ndcg, ap / n_rel AS ap, hits / n_rel AS recall, hits / 10 AS precision, coalesce(1 / first, 0) AS rr, hits / least(10, n_rel) AS r_cap FROM z JOIN ideal USING (query_id))
"""


@query(_EVAL + "SELECT round(avg(ndcg), 5) AS ndcg, round(avg(ap), 5) AS map, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(rr), 5) AS mrr, round(avg(r_cap), 5) AS r_cap, round(sum(rr) / (SELECT count(DISTINCT query_id) FROM j), 5) AS mrr_all FROM v")
def retrieval_measures(spark, d):
    return E.evaluate(bm25_run(spark, d), P.checkpointed(qrels(spark, d)), 10)


@query(f"WITH {X.SQL_POSTINGS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p) SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM p, n GROUP BY term, n")
def term_statistics(spark, d):
    return R.corpus_statistics(X.postings(spark, d))[0].select("term", "df", r6(F.col("idf"), "idf"))


_OKAPI = f"""WITH {X.SQL_POSTINGS}, l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
t AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM p, c GROUP BY term, n), e AS (SELECT avg(raw) AS e FROM t),
qq AS (SELECT query_id, term, count(*) AS qtf FROM ({X.sql_tokens('benchmark', 'item_id', 'query_id')}) GROUP BY ALL),
s AS (SELECT query_id, p.doc_id, sum(qtf * CASE WHEN raw < 0 THEN 0.25::DOUBLE * e ELSE raw END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))) AS score FROM qq JOIN p USING (term) JOIN t USING (term) JOIN l USING (doc_id), c, e GROUP BY ALL)
SELECT query_id, doc_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) <= 3"""


@query(_OKAPI)
def okapi_topk(spark, d):
    q = X.postings(spark, d, "benchmark", "item_id", "query_id")
    # sums of the same weights differ in their last digits by their order: scores tie within eight digits
    scores = R.okapi_scores(q, X.postings(spark, d)).withColumn("score", F.round("score", 8))
    return R.rank(scores, 3).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {X.SQL_MATRIX}, {X.SQL_SUPPLIERS}, s AS (SELECT query_id, doc_id, sum(qw * weight) AS score FROM sq JOIN m USING (term) GROUP BY ALL HAVING sum(qw * weight) > 500) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def impact_topk(spark, d):
    return R.indexed_search(index.written(X.matrix(spark, d)), X.supplier_queries(spark, d), 10, 500.0)


@query(f"""WITH {X.SQL_MATRIX}, {X.SQL_SUPPLIERS}, o AS (SELECT query_id, doc_id, sum(qw * weight) AS score FROM sq JOIN m USING (term) WHERE term % 5 = 0 GROUP BY ALL HAVING sum(qw * weight) > 0),
gate AS (SELECT query_id, doc_id FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
s AS (SELECT query_id, doc_id, sum(qw * weight * CASE WHEN term % 5 = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS score FROM sq JOIN m USING (term) GROUP BY ALL)
SELECT s.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s SEMI JOIN gate USING (query_id, doc_id) QUALIFY rank <= 10""")
def phrase_gated_topk(spark, d):
    q = X.supplier_queries(spark, d)
    return R.indexed_gated_search(index.written(X.matrix(spark, d)), q, F.col("term") % 5 == 0, 10, 50, 0.5, 2.0)


@query(f"""WITH {X.SQL_MATRIX}, {X.SQL_SUPPLIERS}, need AS (SELECT query_id, least(4, count(*) // 5) AS need FROM sq GROUP BY query_id),
s AS (SELECT query_id, doc_id, count(*) AS n, sum(qw * weight) AS score FROM sq JOIN m USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s JOIN need USING (query_id) WHERE n >= need QUALIFY rank <= 20""")
def minimum_match_topk(spark, d):
    return R.enough_matches(X.supplier_queries(spark, d), X.matrix(spark, d), 20)


_POS = "SELECT l_{0}key AS {1}, l_linenumber AS {2}, l_partkey % 200 AS term, CAST(sum(l_quantity) AS DOUBLE) AS {3} FROM lineitem GROUP BY ALL"


@query(f"""WITH a AS ({_POS.format('supp', 'query_id', 'qpos', 'qw')}), b AS ({_POS.format('order', 'doc_id', 'dpos', 'weight')}),
x AS (SELECT query_id, doc_id, qpos, dpos, sum(qw * weight) AS s FROM a JOIN b USING (term) GROUP BY ALL), y AS (SELECT query_id, doc_id, qpos, max(s) AS s FROM x GROUP BY ALL),
z AS (SELECT query_id, doc_id, sum(s) AS score FROM y GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 5""")
def max_sim_topk(spark, d):
    def side(key, name):
        rows = table(spark, d, "lineitem").groupBy(F.col(key).alias(name), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 200).alias("term"))
        return rows.agg(F.sum("l_quantity").cast("double").alias("weight"))

    return R.rank(max_sim.search(side("l_suppkey", "query_id"), side("l_orderkey", "doc_id"), 5), 5)


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS query_id, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL),
cn AS (SELECT query_id, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM c GROUP BY ALL), en AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) + 1e-9::DOUBLE AS n FROM e GROUP BY ALL),
s AS (SELECT query_id, vec_id AS doc_id, sum(c.x / cn.n * (CAST(e.x AS DOUBLE) / en.n)) AS score FROM c JOIN e USING (i) JOIN cn USING (query_id) JOIN en USING (vec_id) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return R.dense_search(means, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), 10).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {X.SQL_RUN}, x AS (SELECT a.query_id, a.doc_id, a.rank, CASE WHEN (a.doc_id * 7 + b.doc_id) % 10 > (b.doc_id * 7 + a.doc_id) % 10 THEN 1.0 WHEN (a.doc_id * 7 + b.doc_id) % 10 = (b.doc_id * 7 + a.doc_id) % 10 THEN 0.5 ELSE 0 END AS p FROM r a JOIN r b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id)
SELECT query_id, doc_id, round(CAST(sum(p) AS DOUBLE) + 0.001::DOUBLE / rank, 6) AS score FROM x GROUP BY query_id, doc_id, rank""")
def pairwise_preferences(spark, d):
    run = bm25_run(spark, d)
    a, b = run.select("query_id", F.col("doc_id").alias("a")), run.select("query_id", F.col("doc_id").alias("b"))
    pairs = a.join(b, "query_id").where("a <> b").withColumn("s", (F.col("a") * 7 + F.col("b")) % 10)
    return R.with_position_bonus(R.preference_scores(pairs), run).select("query_id", "doc_id", r6(F.col("score"), "score"))


@query(f"WITH {X.SQL_RUN}, o AS (SELECT query_id, doc_id, score FROM r WHERE doc_id <> query_id) SELECT query_id, doc_id, score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1")
def hard_negatives(spark, d):
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("own_id"))
    return R.hard_negatives(bm25_run(spark, d), own)


# sparse vectors


def _pooled(rule, phrase=None):
    return f"SELECT doc_id, term, {rule} AS weight FROM g GROUP BY doc_id, term, is_phrase" if phrase is None else f"SELECT doc_id, term, CASE WHEN is_phrase THEN {phrase} ELSE {rule} END AS weight FROM g GROUP BY doc_id, term, is_phrase"


@query(f"WITH {X.SQL_LOGITS} SELECT doc_id, term, round(weight, 6) AS weight FROM ({_pooled('max(w)')}) WHERE weight > 0")
def max_pooling(spark, d):
    return S.pool(X.logits(spark, d)).select("doc_id", "term", r6(F.col("weight"), "weight"))


@query(f"WITH {X.SQL_LOGITS} SELECT doc_id, term, round(weight, 6) AS weight FROM ({_pooled('max(w)', 'sum(w)')}) WHERE weight > 0")
def phrase_sum_pooling(spark, d):
    return S.pool(X.logits(spark, d), "max", "sum").select("doc_id", "term", r6(F.col("weight"), "weight"))


@query(f"WITH {X.SQL_LOGITS}, n AS (SELECT doc_id, count(DISTINCT pos) AS n FROM g GROUP BY doc_id) SELECT doc_id, term, round(weight, 6) AS weight FROM (SELECT doc_id, term, CASE WHEN is_phrase THEN sum(w) / sqrt(n) ELSE max(w) END AS weight FROM g JOIN n USING (doc_id) GROUP BY doc_id, term, is_phrase, n) WHERE weight > 0")
def phrase_length_pooling(spark, d):
    return S.pool(X.logits(spark, d), "max", "sum", True).select("doc_id", "term", r6(F.col("weight"), "weight"))


@query(f"WITH {X.SQL_LOGITS} SELECT doc_id, term, round(weight, 6) AS weight FROM (SELECT doc_id, term, sum(w) AS weight FROM g WHERE (NOT is_phrase OR from_phrase) AND pos <> 1 GROUP BY ALL) WHERE weight > 0")
def masked_pooling(spark, d):
    rows = S.no_token_to_phrase(S.without_positions(X.logits(spark, d), F.col("pos") == 1))
    return S.pool(rows, "sum").select("doc_id", "term", r6(F.col("weight"), "weight"))


@query(f"WITH {X.SQL_LOGITS} SELECT doc_id, term, round(max(w), 6) AS weight, arg_max(pos, w * 1000000 - pos) AS pos FROM g WHERE w > 0 GROUP BY ALL")
def positional_pooling(spark, d):
    return S.pool_positions(X.logits(spark, d)).select("doc_id", "term", r6(F.col("weight"), "weight"), "pos")


@query(f"WITH {X.SQL_MATRIX}, n AS (SELECT count(DISTINCT doc_id) AS n, count(DISTINCT term) AS t FROM m), x AS (SELECT term, count(*) AS c, sum(abs(weight)) AS a, sum(weight * weight) AS s FROM m GROUP BY term) SELECT round(sum(c) / n, 6) AS l0, round(sum(a) / n, 6) AS l1, round(sum(s) / n, 6) AS l2, round(sum(pow(a / n, 2)), 6) AS flops_reg, round(1 - sum(c) / n / t, 6) AS sparsity FROM x, n GROUP BY n, t")
def representation_norms(spark, d):
    m = X.matrix(spark, d)
    n = m.agg(F.countDistinct("doc_id").alias("n"), F.countDistinct("term").alias("t")).first()
    out = S.norms(m, F.lit(n["n"]), F.lit(n["t"]))
    return out.select(*(r6(F.col(c), c) for c in out.columns))


@query(f"WITH {X.SQL_MATRIX}, {X.SQL_SUPPLIERS}, a AS (SELECT term, count(*) AS n FROM m GROUP BY term), b AS (SELECT term, count(*) AS n FROM sq GROUP BY term) SELECT round(sum((a.n / (SELECT count(DISTINCT doc_id) FROM m)) * (b.n / (SELECT count(DISTINCT query_id) FROM sq))), 6) AS flops FROM a JOIN b USING (term)")
def expected_flops(spark, d):
    m, q = X.matrix(spark, d), X.supplier_queries(spark, d)
    n_d, n_q = (x.agg(F.countDistinct(c)).first()[0] for x, c in ((m, "doc_id"), (q, "query_id")))
    return S.expected_flops(m, q, F.lit(n_d), F.lit(n_q)).select(r6(F.col("flops"), "flops"))


@query(f"WITH {X.SQL_MATRIX} SELECT term, count(*) AS n, round(count(*) / (SELECT count(DISTINCT doc_id) FROM m), 6) AS p FROM m GROUP BY term")
def posting_lengths(spark, d):
    m = X.matrix(spark, d)
    n = m.select(F.countDistinct("doc_id").alias("docs"))
    return S.posting_lengths(m).crossJoin(F.broadcast(n)).select("term", "n", r6(F.col("n") / F.col("docs"), "p"))


@query(f"WITH {X.SQL_MATRIX} SELECT * FROM m WHERE weight > 30")
def value_pruning(spark, d):
    return S.prune_by_value(X.matrix(spark, d), 0.3)


@query(f"WITH {X.SQL_MATRIX} SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 3")
def size_pruning(spark, d):
    return S.top_terms(X.matrix(spark, d), 3)


@query(f"WITH {X.SQL_MATRIX}, c AS (SELECT term, quantile_cont(weight, 0.75) AS cut FROM m GROUP BY term) SELECT m.* FROM m JOIN c USING (term) WHERE weight > cut")
def quantile_pruning(spark, d):
    return S.prune_by_quantile(X.matrix(spark, d), 0.75)


@query(f"WITH {X.SQL_MATRIX} SELECT doc_id, term, max(weight) AS weight FROM (SELECT * FROM m UNION ALL SELECT doc_id, term + doc_id % 3, weight / 2 FROM m) GROUP BY ALL")
def merge_max(spark, d):
    m = X.matrix(spark, d)
    return S.merge_max(m, m.select("doc_id", (F.col("term") + F.col("doc_id") % 3).alias("term"), (F.col("weight") / 2).alias("weight")))


@query(f"WITH {X.SQL_MATRIX}, o AS (SELECT doc_id, term + 5 * (doc_id % 2) AS term, weight * 2 AS weight FROM m WHERE term % 5 = 0) SELECT * FROM m ANTI JOIN o USING (doc_id, term) UNION ALL SELECT * FROM o")
def merge_phrase_terms(spark, d):
    m = X.matrix(spark, d)
    other = m.select("doc_id", (F.col("term") + F.when(F.col("term") % 5 == 0, 5 * (F.col("doc_id") % 2)).otherwise(0)).alias("term"), (F.col("weight") * 2).alias("weight"))
    return S.merge_phrases(m, other, F.col("term") % 5 == 0)


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS truncated, list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 100, 0) AS INTEGER)) AS rounded, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS length FROM embeddings")
def quantised_vectors(spark, d):
    x = lambda v: v.cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: V.truncate_weight(x(v))).alias("truncated"), F.transform("embedding", lambda v: V.round_weight(x(v))).alias("rounded"), r6(V.norm(F.col("embedding")), "length"))


# phrases


@query(f"SELECT term AS phrase, count(*) AS n FROM ({X.sql_tokens()}) WHERE term NOT IN ('the', 'of', 'and', 'la', 'de') GROUP BY term HAVING count(*) >= 20")
def word_vocabulary(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(T.search_tokens(F.col("text"))).alias("phrase"))
    base = spark.createDataFrame([(w,) for w in ("the", "of", "and", "la", "de")], "phrase string")
    return P.vocabulary(words, 20, base)


_W = X.sql_tokens().split("unnest(")[1].rsplit(") AS term", 1)[0]
_BIGRAMS = f"b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM (SELECT doc_id, {_W} AS w FROM documents))"


def bigrams(spark, d):
    """(doc_id, phrase), distinct."""
    docs = X.texts(spark, d).select("doc_id", T.search_tokens(F.col("text")).alias("tokens"))
    return P.distinct_ngrams(docs, 2)


@query(f"WITH {_BIGRAMS} SELECT phrase, count(DISTINCT doc_id) AS n FROM b GROUP BY phrase HAVING count(DISTINCT doc_id) >= 25")
def phrase_vocabulary(spark, d):
    return P.vocabulary(bigrams(spark, d), 25)


def common_bigrams(spark, d):
    rows = bigrams(spark, d)
    return rows.join(bounded(P.checkpointed(P.vocabulary(rows, 25).select("phrase"))), "phrase", "left_semi")


@query()
def greedy_cover(spark, d):
    return P.greedy_cover(common_bigrams(spark, d), 20)


@query(f"WITH {_BIGRAMS}, v AS (SELECT phrase FROM b GROUP BY phrase HAVING count(DISTINCT doc_id) >= 25) SELECT round(count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM b), 6) AS coverage FROM b SEMI JOIN v USING (phrase)")
def vocabulary_coverage(spark, d):
    rows = bigrams(spark, d)
    return P.coverage(rows, P.vocabulary(rows, 25)).select(r6(F.col("coverage"), "coverage"))


@query("WITH n AS (SELECT DISTINCT p_name AS phrase FROM part), k AS (SELECT phrase, row_number() OVER (ORDER BY length(phrase), phrase) AS rank FROM (SELECT DISTINCT unnest(string_split(phrase, ' ')) AS phrase FROM n)) SELECT phrase, rank FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.rank < a.rank AND contains(a.phrase, b.phrase))")
def contained_phrases(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("phrase")).distinct()
    return P.without_earlier_parts(words.withColumn("rank", F.row_number().over(Window.orderBy(F.length("phrase"), "phrase"))))


_DOCM = f"""WITH {X.SQL_PAIRS}, k AS (SELECT doc_id, 5 AS k, n_targets FROM nt), c AS (SELECT doc_id, pos, rel, sum(rel) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, pos) AS ideal FROM h),
a AS (SELECT doc_id, sum(CASE WHEN pos <= 5 THEN rel ELSE 0 END) AS hits, sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg, sum(CASE WHEN pos <= 5 THEN rel * seen / pos ELSE 0 END) AS ap FROM c GROUP BY doc_id),
v AS (SELECT k.doc_id, k.k, coalesce(hits, 0) AS hits, n_targets, coalesce(hits, 0) / 5 AS precision, CASE WHEN n_targets > 0 THEN coalesce(hits, 0) / n_targets ELSE 0 END AS recall, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, CASE WHEN n_targets > 0 THEN coalesce(ap, 0) / n_targets ELSE 0 END AS ap FROM k LEFT JOIN a USING (doc_id)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM v)"""


@query(_DOCM + "SELECT doc_id, CAST(hits AS DOUBLE) AS hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM f")
def keyphrase_measures(spark, d, pairs=X.keyphrase_words):
    rows = P.document_measures(pairs(spark, d), 5)
    return rows.select("doc_id", "hits", *(r6(F.col(c), c) for c in ("precision", "recall", "f1", "ndcg", "ap")))


@query(_DOCM + ", s AS (SELECT avg(precision) AS macro_p, avg(recall) AS macro_r, sum(hits) / sum(k) AS micro_p, sum(hits) / sum(n_targets) AS micro_r, avg(ndcg) AS ndcg, avg(ap) AS map FROM f) SELECT round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r, round(2 * macro_p * macro_r / (macro_p + macro_r), 6) AS macro_f1, round(micro_p, 6) AS micro_p, round(micro_r, 6) AS micro_r, round(2 * micro_p * micro_r / (micro_p + micro_r), 6) AS micro_f1, round(ndcg, 6) AS ndcg, round(map, 6) AS map FROM s")
def keyphrase_corpus_measures(spark, d, pairs=X.keyphrase_words):
    out = P.corpus_measures(P.document_measures(pairs(spark, d), 5))
    return out.select(*(r6(F.col(c), c) for c in out.columns))


@query(f"""WITH {X.SQL_PAIRS}, x AS (SELECT a.doc_id, a.pos, t.w, CASE WHEN contains(a.w, t.w) OR contains(t.w, a.w) THEN 1 ELSE 0 END AS hit FROM co a JOIN tg t USING (doc_id) WHERE a.role = 'assistant' AND a.pos <= 5),
y AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY doc_id, w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM x)
SELECT doc_id, round(sum(hit * pow(0.5::DOUBLE, seen) / log2(pos + 1)), 6) AS alpha_dcg FROM y GROUP BY doc_id""")
def alpha_dcg(spark, d, pairs=X.keyphrase_words):
    return P.alpha_dcg(pairs(spark, d), 5).select("doc_id", r6(F.col("alpha_dcg"), "alpha_dcg"))


_LISTS = f"""WITH {X.SQL_PAIRS}, l AS (SELECT doc_id, coalesce(list(w ORDER BY pos) FILTER (role = 'assistant'), []) AS p, coalesce(list(w ORDER BY pos) FILTER (role = 'user'), []) AS t FROM docs LEFT JOIN co USING (doc_id) GROUP BY doc_id),
b AS (SELECT *, CASE WHEN len(p) > 1 THEN list_distinct([p[i] || ' ' || p[i + 1] for i in range(1, len(p))]) ELSE [] END AS pb, CASE WHEN len(t) > 1 THEN list_distinct([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) ELSE [] END AS tb FROM l)"""


def _parts(hits: str, a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN {hits}::DOUBLE / len({a}) ELSE 0 END AS p, CASE WHEN len({b}) > 0 THEN {hits}::DOUBLE / len({b}) ELSE 0 END AS r"


@query(f"{_LISTS}, x AS (SELECT doc_id, {_parts('len(list_intersect(p, t))', 'p', 't')} FROM b) SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x")
def set_measures(spark, d, pairs=X.keyphrase_words):
    rows = pairs(spark, d).select("doc_id", O.set_measures(F.col("predictions"), F.col("targets")).alias("m"))
    return rows.select("doc_id", *(r6(F.col(f"m.{c}"), c) for c in ("precision", "recall", "f1")))


@query(f"""{_LISTS}, z AS (SELECT doc_id, p, t, [list_sum([(contains(x, y) OR contains(y, x))::INT for y in t]) > 0 for x in p] AS hp, [list_sum([(contains(x, y) OR contains(y, x))::INT for y in p]) > 0 for x in t] AS ht FROM b),
x AS (SELECT doc_id, CASE WHEN len(t) > 0 THEN len(list_filter(hp[1:len(t)], lambda e: e))::DOUBLE / len(t) ELSE 0 END AS q, CASE WHEN len(p) > 0 THEN len(list_filter(hp, lambda e: e))::DOUBLE / len(p) ELSE 0 END AS p, CASE WHEN len(t) > 0 THEN len(list_filter(ht, lambda e: e))::DOUBLE / len(t) ELSE 0 END AS r FROM z)
SELECT doc_id, round(q, 6) AS r_precision, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x""")
def loose_measures(spark, d, pairs=X.keyphrase_words):
    rows = pairs(spark, d).select("doc_id", O.loose_measures(F.col("predictions"), F.col("targets")).alias("m"))
    return rows.select("doc_id", *(r6(F.col(f"m.{c}"), c) for c in ("r_precision", "precision", "recall", "f1")))


@query(f"""{_LISTS}, x AS (SELECT doc_id, {_parts('len(list_intersect(p, t))', 'p', 't')} FROM b), y AS (SELECT doc_id, {_parts('len(list_intersect(pb, tb))', 'pb', 'tb')} FROM b)
SELECT doc_id, round(x.p, 6) AS p1, round(x.r, 6) AS r1, round(2 * x.p * x.r / (x.p + x.r + 1e-8), 6) AS f1, round(y.p, 6) AS p2, round(y.r, 6) AS r2, round(2 * y.p * y.r / (y.p + y.r + 1e-8), 6) AS f2 FROM x JOIN y USING (doc_id)""")
def rouge_measures(spark, d, pairs=X.keyphrase_words):
    rows = pairs(spark, d).select("doc_id", *(O.rouge(F.col("predictions"), F.col("targets"), n).alias(f"m{n}") for n in (1, 2)))
    return rows.select("doc_id", *(r6(F.col(f"m{n}.{c}"), f"{c}{n}") for n in (1, 2) for c in "prf"))


@query("WITH w AS (SELECT conv_id AS doc_id, turn, text, list_filter(string_split(text, ' '), lambda e: e <> '') AS t FROM conversations) SELECT doc_id, turn, round(CASE WHEN len(t) > 0 THEN len(list_distinct(t))::DOUBLE / len(t) ELSE 0 END, 6) AS unique_words, round(1 - CASE WHEN len(t) > 0 THEN len(list_distinct(t))::DOUBLE / len(t) ELSE 0 END, 6) AS repeated_words FROM w")
def phrase_diversity(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", O.diversity(F.array("text")).alias("m"))
    return rows.select("doc_id", "turn", *(r6(F.col(f"m.{c}"), c) for c in ("unique_words", "repeated_words")))


@query()
def alignment_measures(spark, d):
    rows = X.keyphrase_words(spark, d)
    return rows.select("doc_id", r6(O.meteor(F.col("predictions"), F.col("targets")), "meteor"), r6(O.self_bleu(F.col("predictions")), "self_bleu"))



# citations, triplets, losses


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events), x AS (SELECT *, CASE WHEN s - lag(s + 60) OVER (PARTITION BY user_id ORDER BY s, s + 60, event_id) >= 3600 THEN 1 ELSE 0 END AS new FROM e)
SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, s + 60, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM x""")
def gap_groups(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("s"))
    # equal starts have equal ends, so which of them comes first makes no difference to the groups
    return N.gap_groups(rows.withColumn("e", F.col("s") + 60), "user_id", "s", "e", 3600).select("event_id", "user_id", "group")


@query("SELECT l_partkey AS item, other, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, other) AS INTEGER) AS rank FROM (SELECT a.l_partkey, b.l_partkey AS other, count(*) AS n FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY ALL)) WHERE rank <= 5")
def co_occurrence(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    return N.co_occurring(rows, "l_orderkey", "item", 5)


@query("WITH i AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_orderkey AS g, x.l_suppkey AS a, y.l_suppkey AS b FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey")
def co_citation_pairs(spark, d):
    return N.pairs_in_group(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("l_orderkey", "g")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) <= 2")
def sampled_per_group(spark, d):
    return N.sample_in_group(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 2, "l_orderkey", "l_linenumber", seed="7")


_PN = "x AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_quantity AS DOUBLE) / 10 AS p, CAST(l_tax AS DOUBLE) * 40 AS n, CAST(l_discount AS DOUBLE) * 30 AS tp, CAST(l_tax AS DOUBLE) * 10 AS tn FROM lineitem)"
_LSE = "greatest({0}, {1}) + ln(exp({0} - greatest({0}, {1})) + exp({1} - greatest({0}, {1})))"


@query(f"""WITH {_PN}, y AS (SELECT *, {_LSE.format('p', 'n')} AS z, {_LSE.format('tp', 'tn')} AS tz FROM x) SELECT round(avg(z - p), 6) AS nll, round(avg(ln(1 + exp(-(p - n)))), 6) AS bpr, round(avg(pow((p - n) - (tp - tn), 2)), 6) AS margin_mse,
round(avg(exp(tp - tz) * ((tp - tz) - (p - z)) + exp(tn - tz) * ((tn - tz) - (n - z))), 6) AS kl, round(avg(greatest(p - n, 0) - (p - n) * (line % 2) + ln(1 + exp(-abs(p - n)))), 6) AS bce FROM y""")
def training_losses(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("y"), (F.col("l_quantity").cast("double") / 10).alias("p"), (F.col("l_tax").cast("double") * 40).alias("n"), (F.col("l_discount").cast("double") * 30).alias("tp"), (F.col("l_tax").cast("double") * 10).alias("tn"))
    p, n, tp, tn = map(F.col, ("p", "n", "tp", "tn"))
    return x.agg(r6(F.avg(N.pairwise_nll(p, n)), "nll"), r6(F.avg(N.bpr(p, n)), "bpr"), r6(F.avg(N.margin_mse(p, n, tp, tn)), "margin_mse"), r6(F.avg(N.kl_divergence(p, n, tp, tn)), "kl"), r6(F.avg(N.bce(p - n, F.col("y"))), "bce"))


# filters, sets, text functions


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND len(string_split(text, ' ')) >= 30")
def quality_filter(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "en") & (F.size(F.split("text", " ")) >= 30)).select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY sha256(text)")
def content_distinct(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS last, replace(url, ' ', '-') AS key, length(url) - length(replace(url, ' ', '')) AS spaces FROM pages")
def url_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.last_segment(u).alias("last"), T.term_key(u).alias("key"), T.spaces(u).alias("spaces"))


@query(f"SELECT conv_id, turn, trim(trim(lower(text)), '{X._P}') AS title, list_filter(regexp_split_to_array(lower(text), '[-,()\\s]+'), lambda t: t <> '') AS tokens, array_to_string(list_slice(regexp_split_to_array(trim(text), '\\s+'), 1, 5), ' ') AS head FROM conversations")
def text_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_title(t).alias("title"), T.simple_tokens(t).alias("tokens"), T.first_tokens(t, 5).alias("head"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 1) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def set_operations(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderkey") % 2 == k).select(F.col("o_custkey").alias("id")).distinct() for k in (0, 1))
    named = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return named(a.union(b).distinct(), "union").union(named(a.join(b, "id", "left_anti"), "except")).union(named(a.join(b, "id", "left_semi"), "intersect"))


@query("SELECT l_suppkey, round(regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 4) AS slope, round((avg(l_quantity) / (SELECT avg(l_quantity) FROM lineitem) - 1) * 100, 6) AS gain FROM lineitem GROUP BY l_suppkey")
def trend_and_gain(spark, d):
    rows = table(spark, d, "lineitem")
    whole = rows.agg(F.avg("l_quantity").alias("base"))
    out = rows.groupBy("l_suppkey").agg(F.round(F.regr_slope(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")), 4).alias("slope"), F.avg("l_quantity").alias("m"))
    return out.crossJoin(F.broadcast(whole)).select("l_suppkey", "slope", r6((F.col("m") / F.col("base") - 1) * 100, "gain"))


@query(f"""WITH u AS (SELECT conv_id, turn, text, {_W} AS w FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text, {_W} AS w FROM conversations WHERE role = 'assistant')
SELECT count(*) AS n, round(avg(CASE WHEN contains(lower(a.text), lower(u.text)) THEN 1.0 ELSE 0 END), 6) AS contained, round(avg(CASE WHEN list_has_all(a.w, u.w) THEN 1.0 ELSE 0 END), 6) AS words FROM u JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1""")
def containment_rates(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", T.search_tokens(F.col("text")).alias("w"))
    u, a = c.where("role = 'user'").alias("u"), c.where("role = 'assistant'").alias("a")
    rows = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.contains(F.lower("a.text"), F.lower("u.text")).cast("double")), "contained"), r6(F.avg((F.size(F.array_except("u.w", "a.w")) == 0).cast("double")), "words"))


@query(f"""WITH {X.SQL_POSTINGS}, l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id), qq AS (SELECT query_id, term, count(*) AS qtf FROM ({X.sql_tokens('benchmark', 'item_id', 'query_id')}) GROUP BY ALL), {X.SQL_QRELS},
x AS (SELECT j.query_id, j.doc_id, qq.term, qtf, len, coalesce(tf / len, 1e-10::DOUBLE) AS pr FROM j JOIN qq USING (query_id) JOIN l USING (doc_id) LEFT JOIN p ON p.doc_id = j.doc_id AND p.term = qq.term)
SELECT query_id, doc_id, round(sum(qtf * ln(pr)) / count(*), 6) AS likelihood FROM x GROUP BY ALL""")
def query_likelihood(spark, d):
    pairs = P.checkpointed(qrels(spark, d))
    found = R.query_likelihood(pairs, X.postings(spark, d, "benchmark", "item_id", "query_id"), X.postings(spark, d, only=pairs.select("doc_id").distinct()))
    return found.select("query_id", "doc_id", r6(F.col("likelihood"), "likelihood"))


@query()
def fuzzy_neighbours(spark, d):
    """Of each turn that follows another: the indel ratio of the two whole texts, null where one of them is null."""
    before = F.lag(F.struct("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, d, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(T.fuzzy_ratio()(F.col("text"), F.col("before.text")), 4).alias("ratio"))
