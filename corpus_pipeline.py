"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all documents its predecessor kept and returns the columns of ``documents``; the last one returns the
digests of the tokens. Texts change in ``line_dedup`` (repeated lines go), documents go in the three filters.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import decontam, linedup, neardup, rules
from runloom.llm.queries import TOKENIZER, table, token_digests
from runloom.llm.text import written

#: Words of a shingle in near_dedup; op4_near_duplicates keeps its four.
NEAR_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the isolation forest accept."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are near copies of an earlier line; n_chars counts what is left."""
    return linedup.drop_repeated(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates on shingles of five words."""
    return neardup.keep_first(docs, NEAR_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of the kept texts."""
    return token_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode_tokens),
]

#: Learned verdicts, fuzzy lines and BPE merges are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", spark)
    return STAGES[-1][1](spark, docs, sf_dir)
