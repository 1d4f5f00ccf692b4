"""The operators' queries over the shared tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, html, jaccard, language, media, packing, preferences, quality, suffixes, toxicity, trie, urls, whitening
from tidemark.sources.tables import table


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.conversation_preferences(table(spark, sf_dir, "conversations"))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.every_document(table(spark, sf_dir, "documents"))


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op11_truncation_peeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_preference_pairs, op2_bpe_tree, op3_ngram_jaccard, op4_cost_balanced_packing, op5_quality_divergence, op6_progressive_jpeg, op7_block_rules, op8_host_reputation, op9_string_kernels, op10_bwt_merge, op11_truncation_peeling, op12_kneser_ney, op13_cholesky_jacobi)}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_pairs": preferences.SQL, "op5_quality_divergence": quality.SQL, "op8_host_reputation": urls.SQL, "op11_truncation_peeling": trie.SQL}
