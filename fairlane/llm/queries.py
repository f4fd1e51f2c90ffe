"""Registered queries of the subpackage: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fairlane.llm import (collocations, decontam, html_text, jaccard, language, licenses, lines, packing, paragraphs, pivots, repair,
                          sentencepieces, toxicity)

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(_table(spark, sf_dir, "documents"), extend=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(docs["doc_id"])
    found = language.identify(docs, language.fit(docs.filter(~held_out)))
    return found.select("doc_id", toxicity.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(_table(spark, sf_dir, "documents"), short=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_decoded=True))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


QUERIES = (op1_substring_dedup, op2_toxicity, op3_html_extraction, op4_license_scan, op5_embedding_near_dedup, op6_language_id,
           op7_benchmark_decontamination, op8_line_dedup, op9_ngram_jaccard_join, op10_packing, op11_sentencepiece, op12_phrase_collocations,
           op13_conversation_repair)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.sql(), "op7_benchmark_decontamination": decontam.SQL,
            "op12_phrase_collocations": collocations.SQL, "op13_conversation_repair": repair.SQL}
