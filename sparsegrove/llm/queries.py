"""The queries ``opN_<name>`` of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, lexical_search, line_dedup, mixing, ngram_join, packing, pii, quality_fm, quality_rules, topk, toxicity, url_filter, whitening
from .common import table

#: The vocabulary file of a public tokenizer.
TOKENIZER = "word_bpe_49k.json"
TOXIC_FROM, GOOD_FROM = 0.5, 0.7


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


def op2_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


def op3_risk_controlled_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels")).drop(*quality_rules.RULES, "text_name")


def op4_toxicity_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = toxicity.held_out(5, 0)
    model = toxicity.fit(documents, table(spark, folder, "labels"), ~held_out)
    scores = toxicity.score(documents, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_spans", "spans")


def op5_maxscore_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op7_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op8_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = toxicity.held_out(4, 2)
    machine = quality_fm.fit(documents, table(spark, folder, "labels"), ~held_out)
    scores = quality_fm.score(documents, machine)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op9_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_tokens").alias("tokens"), F.round("_weight", 6).alias("weight"), F.col("_order").alias("order_key"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, folder, "pages"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), 8)


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(lexical_search.index_documents(table(spark, folder, "documents")), table(spark, folder, "benchmark"), 50)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_pii_crf, op3_risk_controlled_rules, op4_toxicity_crf, op5_maxscore_topk, op6_best_fit_packing, op7_parity_sketch_join, op8_quality_fm, op9_temperature_mixing, op10_html_extraction, op11_embedding_whitening, op12_line_dedup, op13_ranked_lexical_search)}
ORACLES = {"op1_url_filter": url_filter.oracle(), "op5_maxscore_topk": topk.oracle(), "op9_temperature_mixing": mixing.oracle(), "op12_line_dedup": line_dedup.oracle(), "op13_ranked_lexical_search": lexical_search.oracle()}
