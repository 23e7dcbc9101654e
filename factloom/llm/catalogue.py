"""Queries of the text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, importance, language_id, lexical_search, licences, line_dedup, near_dedup, ngram_model
from .common import read_table
from .fingerprint import fingerprints
from .line_dedup import drop_recurring_lines
from .near_dedup import near_duplicates
from .packing import pack
from .surrogates import replace_entities
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _fold(modulus: int) -> Column:
    """True for the held-out fold: crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 2, F.lit(False))


@_query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a model of six of seven folds."""
    docs = read_table(spark, sf_dir, "documents")
    model = ngram_model.train(docs.where(~_fold(7)))
    scored = ngram_model.score(docs, model, F.struct("doc_id", _fold(7).alias("held_out")))
    return scored.select("carried.doc_id", "carried.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@_query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return fingerprints(read_table(spark, sf_dir, "documents"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~_fold(4)))
    carried = F.struct("doc_id", _fold(4).alias("held_out"))
    return language_id.identify(docs, model, carried).select("carried.doc_id", "carried.held_out", "lang_pred", "score", "rejected")


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every paragraph that names one."""
    return licences.scan(read_table(spark, sf_dir, "documents"))


@_query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion segments of preference pairs made from all conversations."""
    return chat_format.format_preferences(*chat_format.preference_pairs(read_table(spark, sf_dir, "conversations")))


ORACLE_SQL["op5_chat_formatting"] = chat_format.ORACLE


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs."""
    return drop_recurring_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


@_query
def op7_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into windows of 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))


@_query
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return replace_entities(read_table(spark, sf_dir, "documents"), key="factloom").select("doc_id", "text", "entities_replaced")


@_query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document holds within the item's error budget."""
    return decontaminate.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five words, likeness 0.75."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under the byte-level vocabulary."""
    return token_counts(read_table(spark, sf_dir, "documents"))


@_query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's distribution of words."""
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), longest=1)


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents table."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLE_SQL["op6_line_dedup"] = line_dedup.ORACLE
ORACLE_SQL["op10_minhash_near_dedup"] = near_dedup.ORACLE
ORACLE_SQL["op12_lexical_search"] = lexical_search.ORACLE
ORACLE_SQL["op13_importance_resampling"] = importance.ORACLE
