"""Queries of the index, of staged retrieval, and of operators that learn from the tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encoder_training, index, max_cover, sentences, tagging, transport
from ..operators import evaluation as E
from ..operators import keyphrases as K
from ..operators import phrases as P
from ..operators import ports as M
from ..operators import retrieval as R
from ..operators import sparse as S
from ..operators import triplets as N
from . import fixtures as X
from .catalog import bm25_run, qrels, query, r6
from .fixtures import table

# the index


def two_batches(spark, d):
    """The folder of an index of orders over parts, written as two batches: even and odd orders."""
    m, folder = X.matrix(spark, d), index.scratch(spark)
    for batch in (0, 1):
        index.write(m.where(F.col("doc_id") % 2 == batch), folder, batch)
    return folder


@query(f"WITH {X.SQL_MATRIX} SELECT doc_id, term, weight FROM m WHERE weight > 0")
def index_postings(spark, d):
    """What an index gives back that was appended to and merged."""
    merged = index.scratch(spark)
    index.merge(index.read(spark, two_batches(spark, d)), merged)
    return index.postings(index.read(spark, merged))


@query(f"WITH {X.SQL_MATRIX} SELECT term, CAST(count(*) AS BIGINT) AS n, max(weight) AS most FROM m WHERE weight > 0 GROUP BY term")
def index_lists(spark, d):
    """Sizes and maxima of posting lists, from the columns that stand beside the compressed ones."""
    rows = index.read(spark, two_batches(spark, d)).where("term IS NOT NULL")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.max(F.array_max("maxima")).alias("most"))


# keyphrases


_TOKENS = X.sql_tokens().split("unnest(")[1].rsplit(") AS term", 1)[0]
_PAIRS = f"""tk AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents),
bi AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM tk),
cand AS (SELECT doc_id, phrase, count(*) AS n FROM bi GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"""WITH {X.SQL_POSTINGS}, {_PAIRS}, cw AS (SELECT doc_id, phrase, n, unnest(string_split(phrase, ' ')) AS term FROM cand),
sc AS (SELECT cw.doc_id, phrase, any_value(n) AS n, sum(coalesce(tf, 0)) / (2 + 0.25::DOUBLE) AS score FROM cw LEFT JOIN p ON p.doc_id = cw.doc_id AND p.term = cw.term GROUP BY cw.doc_id, phrase),
pl AS (SELECT sc.*, lower(text) AS t, strpos(lower(text), phrase) AS place FROM sc JOIN documents d ON d.doc_id = sc.doc_id),
present AS (SELECT doc_id, 'present' AS kind, phrase, score * pow(n, 1.5) * CASE WHEN place > 0 THEN 1 + 1 / log2(len(list_filter(regexp_split_to_array(substr(t, 1, place - 1), '\\s+'), lambda x: x <> '')) + 2) ELSE 1 END AS score FROM pl),
v AS (SELECT term FROM p GROUP BY term HAVING count(*) BETWEEN 2 AND 40),
absent AS (SELECT p.doc_id, 'absent' AS kind, p.term AS phrase, CAST(tf AS DOUBLE) AS score FROM (SELECT doc_id + 1 AS doc_id, term, tf FROM p) p SEMI JOIN v ON v.term = p.term JOIN documents d ON d.doc_id = p.doc_id WHERE NOT contains(lower(d.text), p.term)),
r AS (SELECT doc_id, kind, phrase, round(score, 8) AS score FROM (SELECT * FROM present UNION ALL SELECT * FROM absent) WHERE score > 0)
SELECT doc_id, kind, phrase, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY score DESC, phrase) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""")
def keyphrase_driver(spark, d):
    """Present keyphrases from word pairs, absent ones from the terms of the document before (the vectors know both)."""
    texts, posts = X.texts(spark, d), X.postings(spark, d)
    pairs = texts.select("doc_id", F.explode(P.ngrams(T.search_tokens(F.col("text")), 2)).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    own = posts.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    vocabulary = posts.groupBy(F.col("term").alias("phrase")).agg(F.count(F.lit(1)).alias("df")).where("df BETWEEN 2 AND 40")
    before = own.withColumn("doc_id", F.col("doc_id") + 1)
    present = K.keyphrases_of(texts, pairs, own, vocabulary.limit(0), 1 << 30).where("kind = 'present'")
    absent = K.absent_scores(before, texts, vocabulary)
    # sums of the same products tie within eight digits
    rounded = lambda x: x.select("doc_id", "phrase", F.round("score", 8).alias("score"))
    return K.generate(rounded(present), rounded(absent), 10).select("doc_id", "kind", "phrase", F.round("score", 4).alias("score"), "rank")


# staged retrieval

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text):
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


_LETTERS = "[" + ", ".join(f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"
_DEPTHS = [1, 5, 20]


class SharedWords:
    """A scorer port: how many distinct words of a query a text has."""

    def __call__(self, pairs):
        return [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in pairs]


def _stage(name: str, run: str) -> str:
    return f"""SELECT '{name}' AS stage, k, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN hit THEN CASE WHEN k = 1 THEN 1.0 ELSE 1.0 / place END ELSE 0 END), 6) AS mrr
FROM (SELECT own.query_id, k, place, coalesce(CASE WHEN k = 1 THEN tied = 1 ELSE place <= k END, false) AS hit FROM own CROSS JOIN ks LEFT JOIN (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS tied, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM {run}) x ON x.query_id = own.query_id AND x.doc_id = own.own_id) GROUP BY k"""


@query(f"""WITH {X.SQL_BM25}, {X.SQL_QUERIES}, {X.SQL_QRELS}, ks(k) AS (VALUES (1), (5), (20)),
hits AS (SELECT query_id, doc_id, sum(weight) AS score FROM q JOIN w USING (term) GROUP BY ALL HAVING sum(weight) > 0),
sparse AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
own AS (SELECT query_id, min(doc_id) AS own_id FROM j GROUP BY query_id),
qv AS (SELECT item_id AS query_id, {_LETTERS} AS v FROM benchmark), dv AS (SELECT doc_id, {_LETTERS} AS v FROM documents),
pairs AS (SELECT query_id, doc_id, round(list_dot_product(qv.v, dv.v) / greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-9) / greatest(sqrt(list_dot_product(dv.v, dv.v)), 1e-9), 8) AS score FROM qv, dv WHERE dv.v IS NOT NULL),
dense AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
reranked AS (SELECT query_id, doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(b.text), '\\s+')), list_distinct(regexp_split_to_array(lower(d.text), '\\s+')))) AS score FROM dense JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id))
{_stage('sparse', 'sparse')} UNION ALL {_stage('dense', 'dense')} UNION ALL {_stage('dense+rerank', 'reranked')}""")
def staged_retrieval(spark, d):
    """Recall and reciprocal rank of the smallest document that holds a passage: by BM25, by vectors of letters, and reranked."""
    items, docs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").where("text IS NOT NULL")
    # read by each stage: a row a query, and fifty
    own = P.checkpointed(qrels(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("own_id")))
    sparse = bm25_run(spark, d, 50).drop("rank")
    vectors = lambda rows, key: rows.select(key, letter_counts(F.col("text")).alias("v"))
    dense = P.checkpointed(R.dense_search(vectors(items, "query_id"), vectors(docs, "doc_id"), 50, digits=8).drop("rank"))
    found = docs.join(R.bounded(dense.select("doc_id").distinct()), "doc_id", "left_semi")  # no other text shuffles
    pairs = M.with_pair_texts(dense, items.withColumnRenamed("text", "query"), found)
    runs = {"sparse": sparse, "dense": dense, "dense+rerank": M.rerank(pairs, SharedWords).drop("rank")}
    return E.staged_measures(runs, own, _DEPTHS).select("stage", "k", r6(F.col("recall"), "recall"), r6(F.col("mrr"), "mrr"))


@query(f"""WITH {X.SQL_POSTINGS}, dict AS (SELECT term FROM p GROUP BY term HAVING count(*) >= 3 AND regexp_matches(term, '^([a-zA-Z]+-)*[a-zA-Z]+((\\s|-)[0-9]+){{0,1}}$') AND length(term) > 1),
pd AS (SELECT p.* FROM p SEMI JOIN dict USING (term)), l AS (SELECT doc_id, sum(tf) AS len FROM pd GROUP BY doc_id),
qq AS (SELECT query_id, term, count(*) AS qtf FROM ({X.sql_tokens('benchmark', 'item_id', 'query_id')}) GROUP BY ALL), qd AS (SELECT qq.* FROM qq SEMI JOIN dict USING (term)), {X.SQL_QRELS},
x AS (SELECT j.query_id, j.doc_id, qtf, coalesce(tf / len, 1e-10::DOUBLE) AS pr FROM j JOIN qd USING (query_id) LEFT JOIN l USING (doc_id) LEFT JOIN pd ON pd.doc_id = j.doc_id AND pd.term = qd.term)
SELECT query_id, doc_id, round(sum(qtf * ln(pr)) / count(*), 6) AS likelihood FROM x GROUP BY ALL""")
def dictionary_likelihood(spark, d):
    """Query likelihood over words of a dictionary alone: valid words of three documents or more."""
    pairs = P.checkpointed(qrels(spark, d))
    posts = X.postings(spark, d, only=pairs.select("doc_id").distinct())
    dictionary = P.checkpointed(X.postings(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 3").where(P.valid_word(F.col("term"))))
    found = R.query_likelihood(pairs, X.postings(spark, d, "benchmark", "item_id", "query_id"), posts, dictionary)
    return found.select("query_id", "doc_id", r6(F.col("likelihood"), "likelihood"))


# vectors and vocabularies


@query(f"WITH {X.SQL_MATRIX} SELECT doc_id, list(term ORDER BY weight DESC, term) AS terms, list(round(weight / 3, 2) ORDER BY weight DESC, term) AS scores FROM m GROUP BY doc_id")
def term_scores(spark, d):
    return S.term_scores(X.matrix(spark, d).withColumn("weight", F.col("weight") / 3))


@query(f"""WITH {X.SQL_POSTINGS}, n AS (SELECT term AS phrase, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM p GROUP BY term), f AS (SELECT phrase, n, CAST(row_number() OVER (ORDER BY n DESC, phrase) AS INTEGER) AS rank FROM n QUALIFY rank <= 300),
o AS (SELECT phrase FROM n ORDER BY df DESC, phrase LIMIT 300) SELECT f.* FROM f ANTI JOIN o USING (phrase)""")
def frequent_phrases_elsewhere_rare(spark, d):
    """Of the 300 most frequent words those that aren't among the 300 of most documents."""
    counts = P.checkpointed(X.postings(spark, d).groupBy(F.col("term").alias("phrase")).agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")))
    other = counts.orderBy(F.desc("df"), "phrase").limit(300)
    return P.frequent_but_not_in(counts.select("phrase", "n"), 300, other)


@query("SELECT doc_id, coalesce(source, '') || ' . ' || coalesce(text, '') AS source_text FROM documents")
def source_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.source_text(F.col("source"), F.col("text")).alias("source_text"))


@query("""WITH n AS (SELECT DISTINCT n_name AS phrase, l_partkey AS doc_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey), names AS (SELECT DISTINCT phrase FROM n),
sets AS (SELECT a.phrase AS a, b.phrase AS b, c.phrase AS c FROM names a JOIN names b ON a.phrase < b.phrase JOIN names c ON b.phrase < c.phrase),
covered AS (SELECT a, b, c, count(DISTINCT doc_id) AS covered FROM sets JOIN n ON n.phrase IN (a, b, c) GROUP BY a, b, c)
SELECT CAST(coalesce(max(covered), (SELECT count(DISTINCT doc_id) FROM n)) AS BIGINT) AS covered FROM covered""")
def exact_cover(spark, d):
    """The most parts that suppliers of three nations sell."""
    nations = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("phrase"))
    sold = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("doc_id")).join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    return max_cover.exact_cover(sold.select("phrase", "doc_id"), 3, large=True).agg(F.coalesce(F.max("covered"), F.lit(0)).cast("long").alias("covered"))


# learning


@query()
def encoder_training_history(spark, d):
    """(step, loss, average, best) of three epochs over triplets: a text's first eight words, the text, and another text."""
    texts = table(spark, d, "documents").where("text IS NOT NULL")
    phrases = F.array(F.array_join(F.slice(F.split("text", " "), 1, 8), " "))
    rows = N.keyphrase_triplets(texts.select("doc_id", phrases.alias("phrases"), "text"))
    settings = encoder_training.Settings(epochs=3, rate=0.1, flops_query=1e-4, flops_document=1e-4)
    state = encoder_training.train(rows.select("query", "positive", "negative"), settings)
    return encoder_training.history(spark, state, settings.keep).select("step", r6(F.col("loss"), "loss"), r6(F.col("average"), "average"), "best")


@query()
def mover_measures(spark, d):
    """Transport between the assistant's and the user's words of a conversation, by idf and trigrams, to three places."""
    rows = X.keyphrase_words(spark, d).select("doc_id", F.col("predictions").alias("prediction"), F.col("targets").alias("target"))
    return transport.mover_scores(rows, transport.trigram_encoder).select("doc_id", "score", "cost", "gap")


_CORE = "lower(regexp_replace(regexp_replace(regexp_replace(tok, '\\s+$', ''), '[\"'')\\],;:!?”’»]+$', ''), '^[\"''(\\[“‘«]+', ''))"


@query(f"""WITH tok AS (SELECT unnest(regexp_extract_all(text, '\\S+\\s*')) AS tok FROM documents), w AS (SELECT {_CORE} AS w FROM tok),
t AS (SELECT CASE WHEN regexp_matches(regexp_replace(w, '\\.$', ''), '^[-+]?[0-9][0-9.,]*$') THEN '##number##' ELSE regexp_replace(w, '\\.$', '') END AS type, ends_with(w, '.') AND NOT ends_with(w, '..') AS stop FROM w),
c AS (SELECT type, count(*) FILTER (stop) AS a, count(*) FILTER (NOT stop) AS b FROM t WHERE type <> '' GROUP BY type), n AS (SELECT sum(a + b)::DOUBLE AS n, sum(a)::DOUBLE AS s FROM c),
x AS (SELECT *, length(type) - length(replace(type, '.', '')) AS inner_stops FROM c, n WHERE a > 0 AND regexp_matches(type, '[a-z]'))
SELECT type, a AS n_stop, b AS n_plain, round(2 * (a * ln(0.99::DOUBLE) + b * ln(0.01::DOUBLE) - a * ln(s / n) - CASE WHEN b = 0 THEN 0 ELSE b * ln(1 - s / n) END) * exp(inner_stops - length(type)) * (inner_stops + 1) * pow((length(type) - inner_stops)::DOUBLE, -b::DOUBLE), 5) + 0.0::DOUBLE AS score FROM x""")
def abbreviation_scores(spark, d):
    found = sentences.abbreviation_scores(P.checkpointed(sentences.type_counts(sentences.words(X.texts(spark, d).select("doc_id", "text")))))
    return found.select("type", "n_stop", "n_plain", (F.round("score", 5) + 0.0).alias("score"))  # no negative zeros


@query()
def learnt_sentences(spark, d):
    """(doc_id, sentence, start, end) of all texts by the boundaries that they teach."""
    texts = X.texts(spark, d).select("doc_id", "text")
    return sentences.split(texts, sentences.learn(texts)).drop("text")


@query()
def learnt_tags(spark, d):
    """(doc_id, n_tokens, n_right): turns of the assistant tagged as the user's turns teach, against the rule that tagged those."""
    last = lambda w: F.right(w, F.lit(1))
    rule = lambda w: F.when(last(w).isin("e", "n", "s"), "NN").when(last(w).isin("a", "l"), "JJ").when(w.rlike("^[0-9]+$"), "CD").otherwise("XX")
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", F.split("text", " ").alias("tokens"))
    ruled = turns.where("role = 'user'").select("tokens", F.transform("tokens", rule).alias("tags"))
    tagged = tagging.tag(turns.where("role = 'assistant'"), tagging.learn(ruled))
    right = F.filter(F.zip_with("tags", F.transform("tokens", rule), lambda a, b: a == b), lambda same: same)
    return tagged.select("doc_id", F.size("tags").alias("n_tokens"), F.size(right).alias("n_right"))
