"""Sparse vectors as long rows (doc_id, term, weight): pooling, pruning, merging, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import saturate


def pool(logits: DataFrame, rule: str = "max", phrase_rule: str | None = None, by_length: bool = False) -> DataFrame:
    """(doc_id, term, weight) of token logits (doc_id, pos, term, logit[, is_phrase, from_phrase]).

    rule: "max" or "sum" over positions; phrase_rule: another rule for phrase terms; by_length: phrase weights are
    divided by the root of the number of positions.  Weights of 0 are dropped.
    """
    how = {"max": F.max, "sum": F.sum}
    w = saturate(F.col("logit"))
    keys = ["doc_id", "term"] + (["is_phrase"] if phrase_rule else [])
    out = logits.groupBy(*keys).agg(how[rule](w).alias("own"), *([how[phrase_rule](w).alias("phrase")] if phrase_rule else []))
    weight = F.when(F.col("is_phrase"), F.col("phrase")).otherwise(F.col("own")) if phrase_rule else F.col("own")
    if by_length:
        sizes = logits.groupBy("doc_id").agg(F.countDistinct("pos").alias("n"))
        out = out.join(sizes, "doc_id")
        weight = F.when(F.col("is_phrase"), F.col("phrase") / F.sqrt("n")).otherwise(F.col("own")) if phrase_rule else weight
    return out.select("doc_id", "term", weight.alias("weight")).where("weight > 0")


def without_positions(logits: DataFrame, special: Column) -> DataFrame:
    """Logits of special tokens' positions go before pooling."""
    return logits.where(~special)


def no_token_to_phrase(logits: DataFrame) -> DataFrame:
    """Token positions may not activate phrase terms."""
    return logits.where("NOT is_phrase OR from_phrase")


def lexical(vectors: DataFrame, own_terms: DataFrame) -> DataFrame:
    """Only a text's own terms (doc_id, term) keep their weights."""
    return vectors.join(own_terms.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi")


def pool_positions(logits: DataFrame) -> DataFrame:
    """Max pooling that keeps the position of the largest activation (the first one)."""
    w = logits.select("doc_id", "term", "pos", saturate(F.col("logit")).alias("weight")).where("weight > 0")
    return w.groupBy("doc_id", "term").agg(F.max("weight").alias("weight"), F.max_by("pos", F.struct("weight", -F.col("pos"))).alias("pos"))


def top_terms(vectors: DataFrame, k: int) -> DataFrame:
    """Each document's k heaviest terms, ties to the smaller term."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def prune_by_value(vectors: DataFrame, value: float, scale: float = 100) -> DataFrame:
    return vectors.where(F.col("weight") > F.lit(value * scale))


def prune_by_quantile(vectors: DataFrame, q: float) -> DataFrame:
    """Weights above their term's q-quantile (strict: a term's only posting goes)."""
    cuts = vectors.groupBy("term").agg(F.percentile("weight", F.lit(q)).alias("cut"))
    return vectors.join(cuts, "term").where("weight > cut").select(*vectors.columns)


#: Rows of a part that a task aggregates, about.
PART_ROWS = 1 << 20


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n ``rows`` dealt by ``keys`` into parts of about ``PART_ROWS``, so what a task aggregates doesn't grow with the tables."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // PART_ROWS + 1), *keys)


def merge_max(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.unionByName(b)
    return dealt(rows, rows.count(), "doc_id", "term").groupBy("doc_id", "term").agg(F.max("weight").alias("weight"))


def merge_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))


def merge_phrases(normal: DataFrame, other: DataFrame, is_phrase: Column) -> DataFrame:
    """Normal terms, and phrase terms of the other vectors; on a shared term the phrase's weight wins."""
    phrases = other.where(is_phrase)
    return normal.join(phrases.select("doc_id", "term"), ["doc_id", "term"], "left_anti").unionByName(phrases)


def boost(vectors: DataFrame, scores: DataFrame, factor: float = 0.1) -> DataFrame:
    """weight + factor * score for terms that are there already."""
    joined = vectors.join(scores, ["doc_id", "term"], "left")
    return joined.select("doc_id", "term", (F.col("weight") + F.lit(factor) * F.coalesce("score", F.lit(0))).alias("weight"))


def term_scores(vectors: DataFrame, digits: int = 2) -> DataFrame:
    """(doc_id, terms, scores): each document's terms by falling weight (ties by term), rounded; weights of 0 go."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    rows = vectors.where("weight <> 0").groupBy("doc_id").agg(order.alias("x"))
    return rows.select("doc_id", F.col("x.term").alias("terms"), F.transform("x", lambda t: F.round(-t["w"], digits)).alias("scores"))


def posting_lengths(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def expected_flops(docs: DataFrame, queries: DataFrame, n_docs: Column, n_queries: Column) -> DataFrame:
    """Sum over terms of the products of both sides' activation probabilities."""
    d, q = posting_lengths(docs).withColumnRenamed("n", "nd"), posting_lengths(queries).withColumnRenamed("n", "nq")
    return d.join(q, "term").agg(F.sum((F.col("nd") / n_docs) * (F.col("nq") / n_queries)).alias("flops"))


def norms(vectors: DataFrame, n_docs: Column, dim: Column) -> DataFrame:
    """Means over documents of L0, L1, L2, the FLOPS regulariser and sparsity."""
    per = vectors.groupBy("term").agg(F.sum(F.abs("weight")).alias("a"), F.count(F.lit(1)).alias("c"), F.sum(F.col("weight") * F.col("weight")).alias("s"))
    return per.agg((F.sum("c") / n_docs).alias("l0"), (F.sum("a") / n_docs).alias("l1"), (F.sum("s") / n_docs).alias("l2"), F.sum(F.pow(F.col("a") / n_docs, 2)).alias("flops_reg"), (1 - F.sum("c") / n_docs / dim).alias("sparsity"))


def flops_by_kind(vectors: DataFrame, is_phrase: Column, n_docs: Column, magnifier: float = 2.0) -> DataFrame:
    per = vectors.withColumn("p", is_phrase).groupBy("term", "p").agg((F.sum(F.abs("weight")) / n_docs).alias("m"))
    return per.agg(F.sum(F.when(F.col("p"), F.lit(magnifier)).otherwise(F.lit(1.0)) * F.col("m") * F.col("m")).alias("flops_reg"))


def write_index(vectors: DataFrame, table: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """An inverted index as a table bucketed by term: a later join on term needs no shuffle of it."""
    vectors.select("term", "doc_id", "weight").write.bucketBy(buckets, "term").sortBy("term", "doc_id").mode(mode).saveAsTable(table)
