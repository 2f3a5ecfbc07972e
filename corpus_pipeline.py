"""From raw documents to packed training sequences, in stages that each read what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsegrove.llm import mixing, ngram_join, packing, pii, quality_fm, toxicity
from sparsegrove.llm.common import settle, shared_checkpoint, table
from sparsegrove.llm.queries import GOOD_FROM, tokenizer_path

#: The most often that a document of a small source is read more than one of the largest.
REPEATS = 1.25


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    machine = quality_fm.fit(docs, table(spark, folder, "labels"), ~toxicity.held_out(4, 2))
    return quality_fm.keep_good(docs, machine, GOOD_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    settle(spark)
    return pii.redact_documents(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Small sources are repeated up to ``REPEATS`` times; every document is read once at least."""
    settle(spark)
    return mixing.mix_sources(docs, repeats=REPEATS).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    settle(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mixture", source_mixture), ("sequences", sequences)]

#: No SQL says what the trained stages decide; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
