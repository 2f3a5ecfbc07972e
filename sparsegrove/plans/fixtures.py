"""The driver's tables in the roles that the operators need, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, search_tokens
from ..operators.retrieval import bounded
from ..operators.retrieval import postings as counted
from ..operators.sparse import dealt


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table of texts whose rows are dealt out anew if its files give fewer parts than there are cores.

    Work on texts is per row and dear, so one small file shouldn't keep all cores but one idle; large tables have
    parts enough and aren't shuffled.
    """
    rows, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def postings(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id", alias: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf) of a table of texts, or of those of its rows that ``only`` (doc_id) names."""
    rows = texts(spark, folder, name).select(F.col(key).alias(alias), "text")
    rows = rows if only is None else rows.join(bounded(only), alias, "left_semi")
    return counted(rows, search_tokens(F.col("text")), alias)


_P = PUNCTUATION.replace("'", "''")


def sql_tokens(name: str = "documents", key: str = "doc_id", alias: str = "doc_id", text: str = "text") -> str:
    words = f"list_filter(list_transform(regexp_split_to_array(lower({text}), '\\s+'), lambda t: trim(t, '{_P}')), lambda t: t <> '')"
    return f"SELECT {key} AS {alias}, unnest({words}) AS term FROM {name}"


SQL_POSTINGS = f"p AS (SELECT doc_id, term, count(*) AS tf FROM ({sql_tokens()}) GROUP BY ALL)"
SQL_QUERIES = f"q AS (SELECT DISTINCT query_id, term FROM ({sql_tokens('benchmark', 'item_id', 'query_id')}))"
SQL_BM25 = f"""{SQL_POSTINGS}, l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.doc_id, p.term, CAST(floor(100 * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * len / a))) AS BIGINT) AS weight FROM p JOIN l USING (doc_id) JOIN t USING (term), c)"""
SQL_RUN = f"""{SQL_BM25}, {SQL_QUERIES}, s AS (SELECT query_id, doc_id, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN w USING (term) GROUP BY ALL HAVING sum(weight) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"""
SQL_QRELS = "j AS (SELECT b.item_id AS query_id, d.doc_id, 1 + CAST(d.doc_id % 2 AS INTEGER) AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents, parts as terms, quantities as weights: (doc_id, term, weight)."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"), "l_quantity")
    return dealt(lines, lines.count(), "doc_id", "term").groupBy("doc_id", "term").agg(F.sum("l_quantity").cast("double").alias("weight"))


def supplier_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as queries over parts: (query_id, term, weight)."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("term"))
    return rows.agg(F.sum("l_quantity").cast("double").alias("weight"))


SQL_MATRIX = "m AS (SELECT l_orderkey AS doc_id, l_partkey AS term, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)"
SQL_SUPPLIERS = "sq AS (SELECT l_suppkey AS query_id, l_partkey AS term, CAST(sum(l_quantity) AS DOUBLE) AS qw FROM lineitem GROUP BY ALL)"


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as token logits: (doc_id, pos, term, logit, is_phrase, from_phrase)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos"), (F.col("l_partkey") % 50).alias("term"),
        ((F.col("l_quantity").cast("double") - 15) / 10).alias("logit"), (F.col("l_partkey") % 50 >= 40).alias("is_phrase"), (F.col("l_linenumber") % 2 == 0).alias("from_phrase"),
    )


SQL_LOGITS = "g AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS pos, l_partkey % 50 AS term, (CAST(l_quantity AS DOUBLE) - 15) / 10 AS logit, l_partkey % 50 >= 40 AS is_phrase, l_linenumber % 2 = 0 AS from_phrase, ln(1 + greatest((CAST(l_quantity AS DOUBLE) - 15) / 10, 0)) AS w FROM lineitem)"


def keyphrase_words(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, predictions, targets): all of a conversation's distinct assistant words as predictions, the user's as targets."""
    words = lambda role: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "tokens")))), lambda x: x["tokens"])))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", search_tokens(F.col("text")).alias("tokens"))
    return rows.groupBy(F.col("conv_id").alias("doc_id")).agg(words("assistant").alias("predictions"), words("user").alias("targets"))


_W = sql_tokens("conversations").split("unnest(")[1].rsplit(") AS term", 1)[0]
SQL_PAIRS = f"""ct AS (SELECT conv_id AS doc_id, turn, role, {_W} AS tokens FROM conversations),
cw AS (SELECT doc_id, role, turn, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM ct),
cf AS (SELECT doc_id, role, w, min(turn * 1000000 + i) AS o FROM cw GROUP BY ALL),
co AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY o) AS pos FROM cf),
docs AS (SELECT DISTINCT doc_id FROM ct),
tg AS (SELECT doc_id, w FROM co WHERE role = 'user'),
nt AS (SELECT doc_id, count(tg.w) AS n_targets FROM docs LEFT JOIN tg USING (doc_id) GROUP BY doc_id),
np AS (SELECT doc_id, count(x.w) AS n_pred FROM docs LEFT JOIN (SELECT * FROM co WHERE role = 'assistant') x USING (doc_id) GROUP BY doc_id),
h AS (SELECT a.doc_id, a.pos, CASE WHEN tg.w IS NULL THEN 0 ELSE 1 END AS rel FROM co a LEFT JOIN tg ON a.doc_id = tg.doc_id AND a.w = tg.w WHERE a.role = 'assistant')"""
