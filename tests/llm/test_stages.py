"""Pipeline stages on odd tables: nulls, empty texts, repeated rows, columns
with the operators' own names, and no rows at all."""

import random

import pytest
from helpers import docs_of, words
from pyspark.sql import functions as F

import corpus_pipeline
from fairlane.llm import decontam, jaccard, lines, packing, toxicity

NAMES = ("_dropped", "_doc", "row", "key", "lines", "left", "kept", "comp", "at", "n", "w", "th")


def odd(spark):
    rng = random.Random(7)
    texts = {1: "\n".join(" ".join(words(rng, 9)) for _ in range(3)), 2: None, 3: "", 4: " \t\n", 5: "word"}
    texts[6] = texts[1]
    texts[7] = texts[1].split("\n")[0] + "\n" + " ".join(words(rng, 30))
    df = docs_of(spark, texts)
    df = df.unionByName(df.filter("doc_id = 5")).unionByName(spark.createDataFrame([(None, texts[1], None, None, None)], df.schema))
    for c in NAMES:
        df = df.withColumn(c, F.lit(f"extra {c}"))
    return df, texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stage"))
    spark.createDataFrame([(1, 0, 0), (5, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, tables, name, stage):
    df, texts = odd(spark)
    got = stage(spark, df, tables)
    rows = got.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in df.collect()}
        assert stage(spark, df.limit(0), tables).count() == 0
        return
    assert got.columns == df.columns
    assert all(r[c] == f"extra {c}" for r in rows for c in NAMES)
    ids = [r["doc_id"] for r in rows]
    if name in ("toxicity", "benchmark_decontamination"):
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in df.collect())     # nothing here is toxic or contaminated
    if name == "line_dedup":
        by = {r["doc_id"]: r["text"] for r in rows}
        # the null id is the smallest: it keeps its lines, later copies lose theirs and go
        assert by[None] == texts[1] and 1 not in by and 6 not in by and by[7] == texts[7].split("\n")[1]
        assert by[2] is None and by[3] == "" and by[4] == " \t\n" and ids.count(5) == 2
    if name == "ngram_jaccard_join":
        assert {1, 2, 3, 4, 5, 7, None} == set(ids) and 6 not in ids
    assert stage(spark, df.limit(0), tables).count() == 0


def test_operators_ignore_other_columns(spark):
    df, _ = odd(spark)
    assert lines.duplicate_lines(df, short=True).columns == ["doc_id", "line_no", "kept_doc_id", "kept_line_no", "near"]
    assert jaccard.jaccard_components(df).count() == df.count()
    assert packing.pack(df, __import__("public_tokenizers").path("word_bpe_49k.json")).agg(F.countDistinct("doc_id")).first()[0] == 7
    assert decontam.scan(df, df.select(F.col("doc_id").alias("item_id"), "text")).count() == df.count()
    assert toxicity.tag(df, toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))).count() == df.count()
