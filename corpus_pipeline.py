"""The corpus pipeline: language identification, line dedup, near-duplicates, decontamination, tokenizing.

Each stage works on all that the one before kept; its result is written as Parquet in the shared folder
and read again. SQL cannot express naive Bayes, MinHash or byte-pair encoding, so ORACLE_SQL is None and
tests/llm holds the pipeline against a brute-force version.
"""
from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import attraudit
from attraudit.llm import bpe, decontaminate, language_id, line_dedup, near_copies
from attraudit.llm.common import read, stored
from attraudit.llm.queries import tokenizer_path

cloudpickle.register_pickle_by_value(attraudit)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 4)."""
    return language_id.accept(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are frequent on the distinct pages of their source (operator 5); n_chars is counted anew."""
    from pyspark.sql import functions as F

    out = line_dedup.drop_boilerplate(docs, "source", copies=False, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: operator 7's links, completed by MinHash bands, each of Jaccard similarity 0.8 or more."""
    return near_copies.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 3)."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left (operator 1)."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokenized),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
