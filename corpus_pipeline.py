"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before it kept, and is written as Parquet in the shared folder
before the next one reads it. All but the last return the columns of ``documents``, further ones too,
whatever their names. Null texts count as empty ones; rows of a null or repeated id are judged by
their own text; equal rows stay or go together. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pixelloom.llm import decontaminate, line_dedup, packing, quality, simhash
from pixelloom.llm.common import stored, table
from pyspark.sql import DataFrame, SparkSession


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; null and empty texts have a score like any other."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of a smaller id holds as well; rows without id are one
    document, the last. A null text becomes an empty one."""
    return line_dedup.dedup_lines(docs, counts=False)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of the smallest id.
    Texts without words are copies of each other; rows of its id and text stay with the chosen one."""
    return simhash.remove_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; texts without words have none."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens; an empty text is one piece of one token."""
    return packing.pack(docs, *(public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
