"""Every registered query over whole tables: the same rows as its SQL, or sound rows; the pipeline's stages follow one another."""

import os

import pytest

from fairlane.catalog.compare import canon, duck_connect
from fairlane.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    cur = duck_connect(SMALL).execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, cur.fetchall())


@pytest.mark.parametrize("name,table,key", [("op2_toxicity", "documents", "doc_id"), ("op3_html_extraction", "pages", "page_id"),
                                            ("op5_embedding_near_dedup", "embeddings", "vec_id"), ("op6_language_id", "documents", "doc_id"),
                                            ("op9_ngram_jaccard_join", "documents", "doc_id")])
def test_one_row_per_row(spark, name, table, key):
    got = [r[key] for r in queries.queries()[name](spark, SMALL).collect()]
    want = [r[key] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()]
    assert sorted(got) == sorted(want)


def test_language_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = [r for r in queries.op6_language_id(spark, SMALL).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from fairlane.llm.common import keep

        docs = keep(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= ids and left, name
        ids = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in pieces.collect()} == ids
    assert pieces.count() == corpus_pipeline.run(spark, SMALL).count()
