"""A corpus pipeline of operators of ``paritas.llm``: each stage reads what its predecessor kept.

Quality rules, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from paritas.llm.common import load, new_path, with_column


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    return with_column(docs, "text", "n_chars", lambda t: F.length(t).cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality.keep_clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line go, and documents that have no other line."""
    return recounted(line_dedup.drop_duplicates(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: sets of five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_first(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return recounted(decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_docs),
    ("byte-level BPE", tokenise),
]

#: Line dedup, near-dedup and BPE cannot be expressed in SQL; a test holds ``run`` against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
