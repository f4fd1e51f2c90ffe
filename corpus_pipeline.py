"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark
decontamination, packing.

Each stage takes all documents that its predecessor kept, and its decisions
take effect; its rows are written and reread by the next. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fairlane.llm import decontam, jaccard, lines, packing, toxicity
from fairlane.llm.common import keep
from fairlane.llm.queries import TOKENIZER


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores at its threshold or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents that lose all their words."""
    return lines.without_duplicate_lines(docs, short=True)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies stays."""
    return jaccard.one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth of the words or more lies in windows of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.digests(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_duplicate_lines),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: A fitted model and clusters can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
