"""Triplet and loss queries over the driver's tables, with the same thing in SQL.

Customers stand for papers, their orders for groups of co-cited papers, the parts in them for the papers cited.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from ..operators import triplets as T
from .catalog import query, r6
from .fixtures import table


def members(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("paper"), F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("doc_id")).distinct()


def key(*parts: str) -> str:
    return f"md5(concat_ws('|', '0', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


_M = "m AS (SELECT DISTINCT o_custkey AS paper, l_orderkey AS g, l_partkey AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), refs AS (SELECT DISTINCT paper, doc_id FROM m)"


def _negatives(chosen: str) -> str:
    return f"""n AS (SELECT c.paper, c.g, arg_min(r.doc_id, {key('c.g', 'r.doc_id')}) AS negative FROM (SELECT DISTINCT paper, g FROM {chosen}) c JOIN refs r USING (paper)
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.paper = c.paper AND m.g = c.g AND m.doc_id = r.doc_id) GROUP BY ALL)
SELECT paper, g AS "group", query, positive, negative FROM {chosen} JOIN n USING (paper, g)"""


@query(f"""WITH {_M}, s AS (SELECT paper, g FROM (SELECT paper, g FROM m GROUP BY ALL HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY paper ORDER BY {key('paper', 'g')}, g) <= 5),
o AS (SELECT m.*, row_number() OVER (PARTITION BY paper, g ORDER BY {key('g', 'doc_id')}, doc_id) AS place FROM m JOIN s USING (paper, g)),
c AS (SELECT paper, g, max(doc_id) FILTER (place = 1) AS query, max(doc_id) FILTER (place = 2) AS positive FROM o GROUP BY ALL), {_negatives('c')}""")
def co_citation_triplets(spark, d):
    rows = members(spark, d)
    return T.co_citation_triplets(rows, rows.select("paper", "doc_id"))


@query(f"""WITH {_M}, o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY paper, g ORDER BY {key('g', 'doc_id')}, doc_id) <= 5),
p AS (SELECT a.paper, a.g, a.doc_id AS query, b.doc_id AS positive FROM o a JOIN o b ON a.paper = b.paper AND a.g = b.g AND a.doc_id < b.doc_id),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY paper, g ORDER BY {key('g', 'query', 'positive')}, query, positive) <= 8), {_negatives('c')}""")
def group_pair_triplets(spark, d):
    rows = members(spark, d)
    return T.group_pair_triplets(rows, rows.select("paper", "doc_id"))


@query(f"""WITH {_M}, t AS (SELECT m.*, 'order ' || g AS text FROM m), s AS (SELECT DISTINCT paper, g FROM m QUALIFY dense_rank() OVER (PARTITION BY paper ORDER BY {key('paper', 'g')}, g) <= 5),
c AS (SELECT paper, g, text AS query, doc_id AS positive FROM t SEMI JOIN s USING (paper, g) QUALIFY row_number() OVER (PARTITION BY paper, g ORDER BY {key('g', 'doc_id')}, doc_id) = 1), {_negatives('c')}""")
def context_triplets(spark, d):
    rows = members(spark, d)
    return T.context_triplets(rows.withColumn("text", F.concat(F.lit("order "), F.col("group").cast("string"))), rows.select("paper", "doc_id"))


@query(f"""WITH p AS (SELECT doc_id AS paper, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS title, text AS abstract FROM documents WHERE text <> ''),
refs AS (SELECT a.doc_id AS paper, b.doc_id FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id JOIN p ON p.paper = b.doc_id),
b AS (SELECT paper, arg_min(doc_id, {key('paper', 'doc_id')}) AS doc_id FROM refs GROUP BY paper)
SELECT p.paper, p.title AS query, p.abstract AS positive, n.abstract AS negative FROM p JOIN b USING (paper) JOIN p n ON n.paper = b.doc_id WHERE p.title <> ''""")
def title_triplets(spark, d):
    docs = table(spark, d, "documents")
    words = F.split("text", " ")
    papers = docs.select(F.col("doc_id").alias("paper"), F.concat_ws(" ", F.try_element_at(words, F.lit(1)), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))).alias("title"), F.col("text").alias("abstract"))
    side = docs.where("text <> ''").select("source", "lang", "doc_id")
    return T.title_triplets(papers, T.reference_in_group(side.withColumnRenamed("doc_id", "paper"), side, "source", "lang"))


_RING = f"""k AS (SELECT *, {key('doc_id')} AS k FROM base), w AS (SELECT *, count(*) OVER (PARTITION BY substr(k, 1, 2)) AS n, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next FROM k WINDOW o AS (PARTITION BY substr(k, 1, 2) ORDER BY k, doc_id)),
pairs AS (SELECT w.*, x.text AS next_text, x.labels AS next_labels FROM w JOIN base x ON w.next = x.doc_id WHERE n > 1)"""


@query(f"WITH base AS (SELECT doc_id, text, [source, lang] AS labels FROM documents), {_RING} SELECT doc_id, labels[1] || ', ' || labels[2] AS query, text AS positive, next_text AS negative FROM pairs")
def keyphrase_triplets(spark, d):
    return T.keyphrase_triplets(table(spark, d, "documents").select("doc_id", F.array("source", "lang").alias("phrases"), "text"))


@query(f"WITH base AS (SELECT doc_id, text, [source, lang] AS labels FROM documents), {_RING} SELECT doc_id, array_to_string(list_sort(list_filter(labels, lambda x: NOT list_contains(next_labels, x))), ', ') AS query, text AS positive, next_text AS negative FROM pairs WHERE len(list_filter(labels, lambda x: NOT list_contains(next_labels, x))) > 0")
def label_triplets(spark, d):
    return T.label_triplets(table(spark, d, "documents").select("doc_id", F.array("source", "lang").alias("labels"), "text"))


@query(f"""WITH l AS (SELECT DISTINCT o_custkey AS query, l_partkey AS doc_id, max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query, score > 0 ORDER BY {key('query', 'doc_id')}, doc_id) - 1 AS p, count(*) FILTER (score = 0) OVER (PARTITION BY query) AS n FROM l)
SELECT a.query, a.doc_id AS positive, b.doc_id AS negative FROM r a JOIN r b ON a.query = b.query AND b.score = 0 AND b.p = a.p % a.n WHERE a.score > 0 AND a.n > 0""")
def search_log_triplets(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    log = rows.groupBy(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("doc_id")).agg(F.max((F.col("l_quantity") > 40).cast("int")).alias("score"))
    return T.search_log_triplets(log)


@query(f"""SELECT * FROM (SELECT o_orderkey AS id, 'order' AS kind, {key("'order'", 'o_orderkey')} AS order_key FROM orders ORDER BY order_key, id LIMIT 500)
UNION ALL SELECT * FROM (SELECT p_partkey AS id, 'part' AS kind, {key("'part'", 'p_partkey')} AS order_key FROM part ORDER BY order_key, id LIMIT 200)
UNION ALL SELECT s_suppkey, 'supplier', {key("'supplier'", 's_suppkey')} FROM supplier""")
def combined_sources(spark, d):
    ids = lambda name, c: table(spark, d, name).select(F.col(c).alias("id"))
    return T.combine({"order": ids("orders", "o_orderkey"), "part": ids("part", "p_partkey"), "supplier": ids("supplier", "s_suppkey")}, {"order": 500, "part": 200}, "id")


@query("""WITH q AS (SELECT DISTINCT source AS query FROM documents), c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT source AS query, lang AS phrase, n / sum(n) OVER (PARTITION BY source) AS score FROM c),
b AS (SELECT * FROM r WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, phrase) <= 5), l AS (SELECT query, string_agg(phrase, ', ' ORDER BY score DESC, phrase) AS p FROM b GROUP BY query)
SELECT query, CASE WHEN p IS NULL THEN query ELSE query || ', ' || p END AS augmented FROM q LEFT JOIN l USING (query)""")
def augmented_queries(spark, d):
    docs = table(spark, d, "documents")
    counts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    whole = docs.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    related = counts.join(whole, "source").select(F.col("source").alias("query"), F.col("lang").alias("phrase"), (F.col("n") / F.col("all")).alias("score"))
    return T.augment_queries(docs.select(F.col("source").alias("query")), related)


@query("SELECT DISTINCT l_partkey AS doc_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def ids_to_fetch(spark, d):
    known = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("doc_id"))
    return T.to_fetch(table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id")), known)


@query("SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'p' || page_id ELSE url || ' ' || 'p' || page_id END AS text FROM pages")
def assembled_texts(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 3 != 1, F.col("url")).alias("title"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("abstract"))
    return rows.select("doc_id", T.metadata_text(F.col("title"), F.col("abstract")).alias("text"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') OR source IN ('en', 'fr')")
def papers_of_fields(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("fields"))
    return T.with_fields(docs, ["en", "fr"]).select("doc_id")


# losses: the line items of ten order keys as a batch, suppliers as its queries, parts as its documents


def in_batch(spark, d):
    """(batch, i, j, score, score_tokens, score_phrases): square batches of ten, scores from line items."""
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey div 10").alias("batch"), (F.col("l_suppkey") % 10).alias("i"), (F.col("l_partkey") % 10).alias("j"), "l_quantity", "l_discount", "l_tax")
    own = rows.groupBy("batch", "i", "j").agg(F.sum(F.col("l_quantity").cast("double") / 25).alias("score_tokens"), F.sum(F.col("l_discount").cast("double") * 10).alias("score_phrases"), F.max(F.col("l_tax").cast("double")).alias("scale"))
    return own.withColumn("score", F.col("score_tokens") + F.col("score_phrases"))


_BATCH = """own AS (SELECT *, score_tokens + score_phrases AS score FROM (SELECT l_orderkey // 10 AS batch, l_suppkey % 10 AS i, l_partkey % 10 AS j, sum(CAST(l_quantity AS DOUBLE) / 25) AS score_tokens, sum(CAST(l_discount AS DOUBLE) * 10) AS score_phrases, max(CAST(l_tax AS DOUBLE)) AS scale FROM lineitem GROUP BY ALL)),
good AS (SELECT batch, i FROM own WHERE i = j), neg AS (SELECT batch, i, max(score) / 2 AS score, max(score_tokens) / 2 AS score_tokens, max(score_phrases) / 2 AS score_phrases, max(scale) AS scale FROM own GROUP BY ALL),
r AS (SELECT * FROM own SEMI JOIN good USING (batch, i))"""


def _loss_sql(parts) -> tuple[str, str]:
    pieces, sums = [], []
    for n, (column, hard, weight, scaled) in enumerate(parts):
        factor, other = (" * (1 + scale)", " * (1 + n.scale)") if scaled else ("", "")
        pieces.append(f"""x{n} AS (SELECT r.batch, r.i, max(CASE WHEN r.i = r.j THEN r.{column}{factor.replace('scale', 'r.scale')} END) AS own, ln(sum(exp(r.{column}{factor.replace('scale', 'r.scale')})) + exp(max({'n.' + column + other if hard else '0.0'}))) AS whole FROM r JOIN neg n USING (batch, i) GROUP BY r.batch, r.i)""")
        sums.append(f"{weight} * (SELECT avg(whole - own) FROM x{n})")
    return ", ".join(pieces), " + ".join(sums)


def _all_losses_sql() -> str:
    out = []
    for name, parts in L.PHRASE_LOSSES.items():
        pieces, total = _loss_sql(parts)
        out.append(f"SELECT '{name}' AS loss, round(CAST({total} AS DOUBLE), 6) AS value FROM (SELECT 1)".replace("FROM x", f"FROM {name}_x"))
    tables = ", ".join(_loss_sql(parts)[0].replace("x0 AS", f"{name}_x0 AS").replace("x1 AS", f"{name}_x1 AS") for name, parts in L.PHRASE_LOSSES.items())
    return f"WITH {_BATCH}, {tables} " + " UNION ALL ".join(out)


@query(_all_losses_sql())
def phrase_losses(spark, d):
    own = in_batch(spark, d)
    neg = own.groupBy("batch", "i").agg(*((F.max(c) / 2).alias(c) for c in ("score", "score_tokens", "score_phrases")), F.max("scale").alias("scale"))
    out = L.phrase_losses(own.withColumn("scale", F.col("scale") + 1), neg.withColumn("scale", F.col("scale") + 1))
    return out.select("loss", r6(F.col("value"), "value"))


@query("""WITH s AS (SELECT l_orderkey AS q, list(CAST(l_quantity AS DOUBLE) / 10 ORDER BY l_linenumber, l_quantity, l_discount) AS s, list(CAST(l_discount AS DOUBLE) * 50 ORDER BY l_linenumber, l_quantity, l_discount) AS t FROM lineitem GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT s.q, s.s, s.t, ln(list_sum(list_transform(s.s, lambda x: exp(x)))) AS ls, ln(list_sum(list_transform(s.t, lambda x: exp(x)))) AS lt FROM s),
p AS (SELECT q, ls - s[1] AS contrastive, list_sum(list_transform(range(1, len(s) + 1), lambda a: list_sum(list_transform(range(1, len(s) + 1), lambda b: pow((s[a] - s[b]) - (t[a] - t[b]), 2))))) / (len(s) * len(s)) AS mse, list_sum(list_transform(range(1, len(s) + 1), lambda a: exp(t[a] - lt) * ((t[a] - lt) - (s[a] - ls)))) AS kl FROM e)
SELECT round(avg(contrastive), 6) AS contrastive, round(avg(mse), 6) AS mse_margin, round(avg(kl), 6) AS kldiv, round(0.01 * avg(contrastive) + 0.05 * avg(mse) + 0.99 * avg(kl), 6) AS total FROM p""")
def reranker_losses(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("double") / 10).alias("s"), (F.col("l_discount").cast("double") * 50).alias("t")))).alias("x")).where(F.size("x") > 1)
    lists = rows.select(F.transform("x", lambda e: e["s"]).alias("scores"), F.transform("x", lambda e: e["t"]).alias("teacher"))
    out = L.distillation_losses(lists)
    return out.select(*(r6(F.col(c), c) for c in out.columns))


@query("""WITH b AS (SELECT l_suppkey AS batch, l_partkey % 50 AS term, l_orderkey, CAST(l_quantity AS DOUBLE) AS w FROM lineitem), n AS (SELECT batch, count(DISTINCT l_orderkey) AS n, sum(w) AS whole FROM b GROUP BY batch),
f AS (SELECT batch, term, sum(abs(w)) AS s FROM b GROUP BY ALL) SELECT f.batch, round(sum(pow(s / n, 2)), 4) AS flops, round(sum(s) / any_value(n), 4) AS l1, round(1 / pow(any_value(whole), 2), 12) AS anti_zero FROM f JOIN n USING (batch) GROUP BY f.batch""")
def batch_regularisers(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("batch"), F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("term"), F.col("l_quantity").cast("double").alias("weight"))
    return L.regularisers(rows).select("batch", F.round("flops", 4).alias("flops"), F.round("l1", 4).alias("l1"), F.round("anti_zero", 12).alias("anti_zero"))


@query(f"""WITH t AS (SELECT o_custkey AS query_id, l_partkey AS doc_id, CAST(max(l_quantity) AS DOUBLE) AS score, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT query_id, doc_id, CASE WHEN rel = 1 AND doc_id % 5 = 0 THEN NULL ELSE score END AS score, rel FROM t), top AS (SELECT query_id, max(score) AS best FROM s GROUP BY query_id),
p AS (SELECT query_id, doc_id, coalesce(score, best) AS score FROM s JOIN top USING (query_id) WHERE rel = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {key('query_id', 'doc_id')}, doc_id) = 1),
n AS (SELECT query_id, doc_id, score FROM s WHERE rel = 0 AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {key('query_id', 'doc_id')}, doc_id) <= 4)
SELECT p.query_id, p.doc_id AS positive, p.score AS positive_score, n.doc_id AS negative, n.score AS negative_score FROM p JOIN n USING (query_id)""")
def teacher_samples(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = rows.groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.max("l_quantity").cast("double").alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("rel"))
    scores = t.where("NOT (rel = 1 AND doc_id % 5 = 0)").select("query_id", "doc_id", "score")
    return L.teacher_samples(t.where("rel = 1").select("query_id", "doc_id"), scores, 4)


@query(f"SELECT o_orderkey AS id, substr({key('o_orderkey')}, 1, 2) < '1a' AS validation FROM orders")
def validation_split(spark, d):
    return L.validation_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.1)


@query("""WITH v AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, user_id AS run, CAST(value AS DOUBLE) AS value FROM events),
b AS (SELECT *, coalesce(max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) < value AS better FROM v), l AS (SELECT *, max(CASE WHEN better THEN step END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_step FROM b)
SELECT run, step, better, best_step, step - best_step >= 3 AS stop FROM l""")
def early_stopping(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))
    return L.early_stopping(rows, 3).select("run", F.col("step").cast("long").alias("step"), "better", F.col("best_step").cast("long").alias("best_step"), "stop")

