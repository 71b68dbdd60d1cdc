"""The queries of this package, by name, and SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.embedding_dedup import near_vectors
from gneiss.llm.fingerprints import edited_fingerprints
from gneiss.llm.html_extract import extract
from gneiss.llm.line_dedup import line_counts
from gneiss.llm.minhash_dedup import near_duplicates
from gneiss.llm.mixing import mix_words
from gneiss.llm.ngram_lm import lm_scores
from gneiss.llm.packing import packed_documents
from gneiss.llm.quality import quality_scores
from gneiss.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(_table(spark, sf_dir, "documents"))


@_query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


@_query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"), vocabulary())


@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("passages")


@_query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(_table(spark, sf_dir, "documents"))


@_query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
