"""Keyphrase and retrieval measures over the driver's tables, with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..operators import evaluation as E
from ..operators import keyphrases as K
from ..operators import retrieval as R
from ..operators.phrases import checkpointed
from . import fixtures as X
from .catalog import bm25_run, qrels, query, r6
from .fixtures import table

KS = (5, 10, "M", "O", "G")


def whole_pairs(spark, d):
    """(doc_id, source, predictions, targets) of conversations: all assistant words against all user words, the source is the first turn."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", search_tokens(F.col("text")).alias("t"))
    source = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("t", "turn").alias("source"))
    return X.keyphrase_words(spark, d).join(source, "doc_id")


_W = X.sql_tokens("conversations").split("unnest(")[1].rsplit(") AS term", 1)[0]
_BASE = f"""ct AS (SELECT conv_id AS doc_id, turn, role, {_W} AS tokens FROM conversations), cw AS (SELECT doc_id, role, turn, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM ct),
src AS (SELECT DISTINCT doc_id, w FROM cw JOIN (SELECT doc_id, min(turn) AS turn FROM ct GROUP BY doc_id) USING (doc_id, turn)),
co AS (SELECT doc_id, role, w, row_number() OVER (PARTITION BY doc_id, role ORDER BY min(turn * 1000000 + i)) AS pos FROM cw GROUP BY doc_id, role, w),
cs AS (SELECT co.*, src.w IS NOT NULL AS present FROM co LEFT JOIN src ON co.doc_id = src.doc_id AND co.w = src.w),
sub(subset) AS (VALUES ('all'), ('present'), ('absent')), ks(cut) AS (VALUES ('5'), ('10'), ('M'), ('O'), ('G')),
ph AS (SELECT subset, doc_id, role, w, row_number() OVER (PARTITION BY subset, doc_id, role ORDER BY pos) AS pos FROM cs JOIN sub ON subset = 'all' OR (subset = 'present') = present),
n AS (SELECT sub.subset, d.doc_id, count(*) FILTER (role = 'assistant') AS np, count(*) FILTER (role = 'user') AS nt FROM (SELECT DISTINCT doc_id FROM ct) d CROSS JOIN sub LEFT JOIN ph ON ph.subset = sub.subset AND ph.doc_id = d.doc_id GROUP BY ALL),
h AS (SELECT a.subset, a.doc_id, a.pos, CASE WHEN t.w IS NULL THEN 0 ELSE 1 END AS rel FROM ph a LEFT JOIN ph t ON a.subset = t.subset AND a.doc_id = t.doc_id AND a.w = t.w AND t.role = 'user' WHERE a.role = 'assistant'),
hc AS (SELECT *, sum(rel) OVER (PARTITION BY subset, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen, row_number() OVER (PARTITION BY subset, doc_id ORDER BY rel DESC, pos) AS ideal FROM h),
nk AS (SELECT n.*, cut, CASE cut WHEN 'M' THEN np WHEN 'O' THEN nt WHEN 'G' THEN greatest(np, nt) ELSE CAST(cut AS BIGINT) END AS k FROM n, ks),
s AS (SELECT nk.subset, nk.doc_id, cut, k, nt, coalesce(sum(rel) FILTER (pos <= k), 0) AS hits, coalesce(sum(rel / log2(pos + 1)) FILTER (pos <= k), 0) AS dcg, coalesce(sum(rel / log2(ideal + 1)) FILTER (ideal <= k), 0) AS idcg, coalesce(sum(rel * seen / pos) FILTER (pos <= k), 0) AS ap
  FROM nk LEFT JOIN hc USING (subset, doc_id) GROUP BY ALL),
f AS (SELECT *, CASE WHEN k > 0 THEN hits / k ELSE 0 END AS p, CASE WHEN nt > 0 THEN hits / nt ELSE 0 END AS r, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS nd, CASE WHEN nt > 0 THEN ap / nt ELSE 0 END AS m FROM s)"""


@query(f"""WITH {_BASE}, g AS (SELECT subset, cut, avg(p) AS a, avg(r) AS b, CASE WHEN sum(k) > 0 THEN sum(hits) / sum(k) ELSE 0 END AS c, CASE WHEN sum(nt) > 0 THEN sum(hits) / sum(nt) ELSE 0 END AS d, avg(nd) AS ndcg, avg(m) AS map FROM f GROUP BY ALL)
SELECT subset, cut, round(a, 6) AS macro_p, round(b, 6) AS macro_r, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS macro_f1, round(c, 6) AS micro_p, round(d, 6) AS micro_r, round(CASE WHEN c + d > 0 THEN 2 * c * d / (c + d) ELSE 0 END, 6) AS micro_f1, round(ndcg, 6) AS ndcg, round(map, 6) AS map FROM g""")
def present_absent_measures(spark, d):
    out = K.exact_summary(K.exact_scores(K.prepared(whole_pairs(spark, d)), list(KS)))
    return out.select("subset", "cut", *(r6(F.col(c), c) for c in out.columns[2:]))


@query(f"""WITH {_BASE} SELECT 'words' AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) FILTER (subset = 'present' AND cut = '5' AND nt > 0), 6) AS present_f1_5, round(avg(r) FILTER (subset = 'absent' AND cut = '5' AND nt > 0), 6) AS absent_recall_5,
round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) FILTER (subset = 'present' AND cut = '10' AND nt > 0), 6) AS present_f1_10, round(avg(r) FILTER (subset = 'absent' AND cut = '10' AND nt > 0), 6) AS absent_recall_10 FROM f GROUP BY ALL""")
def keyphrase_leaderboard(spark, d):
    rows = K.prepared(whole_pairs(spark, d)).withColumns({"dataset": F.lit("words"), "model": F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")})
    out = K.leaderboard(rows, (5, 10))
    return out.select("dataset", "model", *(r6(F.col(c), c) for c in out.columns[2:]))


@query(f"WITH {_BASE} SELECT count(*) AS n_docs, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM f WHERE subset = 'all' AND cut = '5' AND nt > 0")
def macro_with_targets(spark, d):
    out = K.macro_with_targets(X.keyphrase_words(spark, d), 5)
    return out.select("n_docs", *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


@query()
def alpha_ndcg(spark, d):
    return X.keyphrase_words(spark, d).select("doc_id", r6(K.alpha_ndcg(10)("predictions", "targets"), "alpha_ndcg"))


@query()
def rouge_l(spark, d):
    rows = X.keyphrase_words(spark, d).select("doc_id", K.rouge_l()("predictions", "targets").alias("m"))
    return rows.select("doc_id", *(r6(F.col(f"m.{c}"), c) for c in "prf"))


_SPLIT = f"WITH {_BASE}, o AS (SELECT doc_id, w, pos, present, row_number() OVER (PARTITION BY doc_id, present ORDER BY pos) AS place FROM cs WHERE role = 'assistant')"


@query(f"{_SPLIT}, l AS (SELECT doc_id, list(w ORDER BY present DESC, pos) AS predictions FROM o WHERE place <= 5 GROUP BY doc_id) SELECT d.doc_id, coalesce(predictions, []) AS predictions FROM (SELECT DISTINCT doc_id FROM ct) d LEFT JOIN l USING (doc_id)")
def converted_results(spark, d):
    keep = lambda want: F.filter("predictions", lambda p: K.in_source(p, F.col("source")) == want)
    return K.converted(whole_pairs(spark, d).select("doc_id", keep(True).alias("present"), keep(False).alias("absent")), 5)


_GEN = f"""{X.SQL_POSTINGS}, t AS (SELECT term, count(*) AS df FROM p GROUP BY term), v AS (SELECT term FROM t WHERE df BETWEEN 2 AND 40),
o AS (SELECT doc_id + 1 AS doc_id, term, CAST(tf AS DOUBLE) AS weight FROM p)"""


@query(f"WITH {_GEN}, a AS (SELECT o.doc_id, o.term AS phrase, weight AS score FROM o SEMI JOIN v ON o.term = v.term JOIN documents d ON d.doc_id = o.doc_id WHERE NOT contains(lower(d.text), o.term)) SELECT doc_id, 'absent' AS kind, phrase, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS rank FROM a WHERE score > 0 QUALIFY rank <= 10")
def absent_keyphrases(spark, d):
    posts = X.postings(spark, d)
    vectors = posts.select((F.col("doc_id") + 1).alias("doc_id"), "term", F.col("tf").cast("double").alias("weight"))
    vocabulary = posts.groupBy(F.col("term").alias("phrase")).agg(F.count(F.lit(1)).alias("df")).where("df BETWEEN 2 AND 40")
    absent = K.absent_scores(vectors, table(spark, d, "documents"), vocabulary)
    return K.generate(absent.limit(0), absent, 10)


@query(f"""WITH {X.SQL_RUN}, {X.SQL_QRELS}, ks(k) AS (VALUES (1), (3), (10)), i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM j),
ideal AS (SELECT query_id, k, sum(CASE WHEN n <= k THEN rel / log2(n + 1) ELSE 0 END) AS ideal, count(*) AS n_rel FROM i, ks GROUP BY ALL),
x AS (SELECT r.query_id, r.rank, coalesce(j.rel, 0) AS rel FROM r LEFT JOIN j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE r.query_id IN (SELECT query_id FROM j)),
y AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM x),
z AS (SELECT query_id, k, sum(CASE WHEN rank <= k THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= k AND rel > 0 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN rank <= k AND rel > 0 THEN seen / rank ELSE 0 END) AS ap, min(CASE WHEN rank <= k AND rel > 0 THEN rank END) AS first FROM y, ks GROUP BY ALL)
SELECT z.k, round(avg(dcg / ideal), 5) AS ndcg, round(avg(ap / n_rel), 5) AS map, round(avg(hits / n_rel), 5) AS recall, round(avg(hits / z.k), 5) AS precision, round(avg(coalesce(1 / first, 0)), 5) AS mrr, round(avg(hits / least(z.k, n_rel)), 5) AS r_cap FROM z JOIN ideal ON z.query_id = ideal.query_id AND z.k = ideal.k GROUP BY z.k""")
def measures_at_depths(spark, d):
    return E.evaluate_at(bm25_run(spark, d), qrels(spark, d), [1, 3, 10])


@query(f"""WITH {X.SQL_RUN}, {X.SQL_QRELS}, x AS (SELECT r.query_id, r.rank, j.rel FROM r LEFT JOIN j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE r.query_id IN (SELECT query_id FROM j)), n AS (SELECT query_id, count(*) AS n FROM j GROUP BY query_id),
qv AS (SELECT query_id, count(rel) FILTER (rank <= 5) / any_value(n) AS a, coalesce(1 / min(CASE WHEN rel > 0 AND rank <= 10 THEN rank END), 0) AS b, count(rel) FILTER (rank <= 5) / 5 AS c FROM x JOIN n USING (query_id) GROUP BY query_id),
g AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM qv)
SELECT dataset, measure, round(CASE measure WHEN 'recall_5' THEN a WHEN 'MRR@10' THEN b ELSE c END, 6) AS value FROM g, (VALUES ('one'), ('two')) s(dataset), (VALUES ('recall_5'), ('MRR@10'), ('P_5')) m(measure)""")
def measures_of_datasets(spark, d):
    run, judged = bm25_run(spark, d), qrels(spark, d)
    out = E.evaluate_datasets({"one": run, "two": run}, {"one": judged, "two": judged}, ["recall_5", "MRR@10", "P_5"])
    return out.select("dataset", "measure", r6(F.col("value"), "value"))


@query("""WITH r AS (SELECT l_suppkey AS query_id, l_partkey % 100 AS doc_id, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL), o AS (SELECT s_suppkey AS query_id, s_suppkey % 100 AS own_id FROM supplier),
x AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS tied, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM r), h AS (SELECT o.query_id, tied, place FROM o LEFT JOIN x ON o.query_id = x.query_id AND own_id = doc_id), ks(k) AS (VALUES (1), (5), (50)),
y AS (SELECT k, place, coalesce(CASE WHEN k = 1 THEN tied = 1 ELSE place <= k END, false) AS found FROM h, ks) SELECT k, round(avg(CAST(found AS INTEGER)), 6) AS recall, round(avg(CASE WHEN found THEN CASE WHEN k = 1 THEN 1.0 ELSE 1 / place END ELSE 0 END), 6) AS mrr FROM y GROUP BY k""")
def own_document_measures(spark, d):
    run = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 100).alias("doc_id")).agg(F.sum("l_quantity").cast("double").alias("score"))
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 100).alias("own_id"))
    return E.own_document_measures(run, own, [1, 5, 50]).select("k", r6(F.col("recall"), "recall"), r6(F.col("mrr"), "mrr"))


@query("WITH t AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY ALL), b AS (SELECT min(name) AS b FROM t) SELECT name, round(value, 6) AS value, round(100 * ((SELECT value FROM t, b WHERE name = b) - value) / (SELECT value FROM t, b WHERE name = b), 6) AS drop FROM t")
def drop_from_base(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    base = rows.agg(F.min("name")).first()[0]
    out = E.drop_from(rows, "name", "value", base)
    return out.select("name", r6(F.col("value"), "value"), r6(F.col("drop"), "drop"))


@query("SELECT round(sqrt(avg(pow(CAST(l_quantity AS DOUBLE) - l_linenumber, 2))), 6) AS rmse, round(avg(abs(CAST(l_quantity AS DOUBLE) - l_linenumber)), 6) AS mae FROM lineitem")
def error_measures(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_linenumber").cast("double").alias("b"))
    return E.errors(rows, "a", "b").select(r6(F.col("rmse"), "rmse"), r6(F.col("mae"), "mae"))


@query(f"WITH {X.SQL_MATRIX}, o AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS term FROM lineitem WHERE l_linenumber = 1) SELECT term, count(*) AS n FROM m ANTI JOIN o USING (doc_id, term) WHERE weight >= 30 GROUP BY term")
def expansion_popularity(spark, d):
    own = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"))
    return E.expansion_popularity(X.matrix(spark, d), own, 30)


@query(f"WITH {X.SQL_BM25}, {X.SQL_QUERIES}, e AS (SELECT term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf FROM t, c), s AS (SELECT query_id, doc_id, CAST(sum(weight) AS BIGINT) AS score FROM q SEMI JOIN (SELECT term FROM e WHERE idf > 3) k USING (term) JOIN w USING (term) GROUP BY ALL HAVING sum(weight) > 0) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def idf_gated_topk(spark, d):
    posts = X.postings(spark, d)
    q = X.postings(spark, d, "benchmark", "item_id", "query_id").select("query_id", "term", F.lit(1).alias("weight"))
    gated = checkpointed(R.idf_gate(q, R.corpus_statistics(posts)[0], 3.0))
    return R.search(gated, R.bm25_impacts(posts, wanted=gated), 10)


@query(f"WITH {X.SQL_RUN}, lb AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL), m AS (SELECT item_id AS query_id, lb.quality FROM benchmark LEFT JOIN lb ON lb.doc_id = item_id), o AS (SELECT r.query_id, r.doc_id, r.score FROM r JOIN m USING (query_id) JOIN lb ON lb.doc_id = r.doc_id WHERE r.doc_id <> r.query_id AND m.quality <> lb.quality) SELECT query_id, doc_id, score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1")
def labelled_hard_negatives(spark, d):
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("own_id"))
    labels = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.array(F.col("quality").cast("string")).alias("labels"))
    return R.hard_negatives(bm25_run(spark, d), own, labels)


@query("WITH p AS (SELECT DISTINCT p_name AS phrase FROM part), w AS (SELECT phrase, string_split(phrase, ' ') AS w FROM p), r AS (SELECT phrase, n, i, array_to_string(w[i : i + n - 1], ' ') AS part FROM w, (VALUES (2), (3)) v(n), generate_series(1, 12) g(i) WHERE i + n - 1 <= len(w)), c AS (SELECT part, count(*) AS c FROM r WHERE n = 2 GROUP BY part) SELECT phrase, arg_max(part, c * 1000 - i) AS part FROM r JOIN c USING (part) GROUP BY phrase")
def best_phrase_parts(spark, d):
    from ..operators import phrases as P

    tokens = table(spark, d, "part").select(F.col("p_name").alias("phrase"), F.split("p_name", " ").alias("words")).distinct()
    counts = tokens.select(F.explode(P.ngrams(F.col("words"), 2)).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return K.best_part(tokens, counts, 3)


@query("WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w FROM part), e AS (SELECT doc_id, unnest(w) AS phrase, generate_subscripts(w, 1) - 1 AS i FROM w), c AS (SELECT doc_id, phrase, count(*) AS score, min(i) AS first FROM e GROUP BY ALL) SELECT doc_id, phrase, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, phrase) AS INTEGER) AS rank FROM c QUALIFY rank <= 2")
def candidate_topk(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split("p_name", " ")).alias("i", "phrase"))
    counts = rows.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("score"), F.min("i").alias("first"))
    return K.top_candidates(counts, 2).select("doc_id", "phrase", "score", "rank")


@query(f"""WITH {_BASE}, two AS (SELECT subset, doc_id, role, w || ' ' || lead(w) OVER (PARTITION BY subset, doc_id, role ORDER BY pos) AS w FROM ph),
runs AS (SELECT DISTINCT 1 AS n, subset, doc_id, role, w FROM ph UNION ALL SELECT DISTINCT 2 AS n, subset, doc_id, role, w FROM two WHERE w IS NOT NULL),
c AS (SELECT n, subset, doc_id, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS b FROM runs GROUP BY ALL),
m AS (SELECT x.n, x.subset, x.doc_id, count(*) AS hits FROM runs x JOIN runs y ON x.n = y.n AND x.subset = y.subset AND x.doc_id = y.doc_id AND x.w = y.w WHERE x.role = 'assistant' AND y.role = 'user' GROUP BY ALL),
v AS (SELECT k.n, sub.subset, d.doc_id, CASE WHEN a > 0 THEN coalesce(hits, 0) / a ELSE 0 END AS p, CASE WHEN b > 0 THEN coalesce(hits, 0) / b ELSE 0 END AS r FROM (SELECT DISTINCT doc_id FROM ct) d CROSS JOIN sub CROSS JOIN (VALUES (1), (2)) k(n)
  LEFT JOIN c ON c.n = k.n AND c.subset = sub.subset AND c.doc_id = d.doc_id LEFT JOIN m ON m.n = k.n AND m.subset = sub.subset AND m.doc_id = d.doc_id)
SELECT subset, n, round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(2 * p * r / (p + r + 1e-8::DOUBLE)), 6) AS f FROM v GROUP BY ALL""")
def rouge_by_subset(spark, d):
    return K.rouge_by_subset(K.prepared(whole_pairs(spark, d))).select("subset", "n", *(r6(F.col(c), c) for c in "prf"))
