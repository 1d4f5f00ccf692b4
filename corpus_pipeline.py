"""A corpus from raw documents to packed sequences, as stages that are written and read again.

Documents are named by doc_id; the near-duplicate stages keep rows without one as they are. All
stages but the last return the columns of ``documents``.
"""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, language, packing, quality, suffixes
from tidemark.llm.shared import discard, run_folder, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernels can tell, with that language; those without a letter, or that no classifier claims, go."""
    return language.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules and lie near the reference of their predicted language."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id, repeated rows once."""
    kept = jaccard.jaccard_components(docs).where("doc_id = component_id").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.union(docs.where(docs["doc_id"].isNull()))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that an earlier place has."""
    return suffixes.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: SQL cannot express the language model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result goes through Parquet in the shared folder.

    What a stage writes on its way has a folder of its own, which goes once its result is written;
    so does its predecessor's result.
    """
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        with run_folder(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if docs is not first:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
