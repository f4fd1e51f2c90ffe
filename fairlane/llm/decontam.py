"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Built-in functions only. Every text is split into words once; each window of
words is hashed and looked up among the test windows, hits are verified by
comparing the words, and each document's hits are put together. The same scan
carries one row per document (position 0), so documents without hits need no
second pass. The test windows are broadcast after a check of their size;
beyond ``BROADCAST_BYTES`` the look-up is a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import keep

NGRAM = 13
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and all beyond ASCII. Null has none."""
    # lower() is faster and does the same where all is ASCII
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), NOT_WORD), "")


def test_windows(items: DataFrame, n: int = NGRAM) -> DataFrame:
    """(h, len, gram, items): the distinct windows of the test items, with the ids of the items that have them."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    grams = w.select("item", "len", "w", at.alias("at")).select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("h"), "len", "gram", "items")


def scan(docs: DataFrame, items: DataFrame, n: int = NGRAM, percent: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A document word is hit if it lies inside a window of ``n`` words that a
    test item has too (an item of fewer words is one window). spans are the
    hit runs as (first, last) word numbers from 1. contaminated: at least
    ``percent`` % of the words are hit. Null and empty texts have no words and
    are clean; rows that repeat an id with the same text are counted together
    and returned as often; other columns are not read. No items: nothing is hit.
    """
    grams = keep(test_windows(items, n), "test-windows")
    lens = [r[0] for r in grams.select("len").distinct().collect()] or [n]      # at most n numbers
    size = grams.agg(F.sum(F.size("gram") * 24 + F.size("items") * 24 + 64)).first()[0] or 0
    test = grams.select("h", F.col("len").alias("t_len"), "gram", "items")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    d = d.withColumn("n", F.size("w"))
    rows = d.select("doc_id", "th", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("pos"))
    if len(lens) == 1:
        rows = rows.withColumn("len", F.lit(lens[0]))
    else:
        rows = rows.withColumn("len", F.explode(F.array(*map(F.lit, lens)))).filter(f"pos > 0 OR len = {lens[0]}")
    rows = rows.filter("pos = 0 OR pos + len - 1 <= n")
    rows = rows.withColumn("cut", F.when(F.col("pos") > 0, F.slice("w", F.greatest("pos", F.lit(1)), F.col("len"))))
    rows = rows.select("doc_id", "th", "n", "pos", "len", "cut", F.when(F.col("pos") > 0, F.xxhash64("cut")).alias("k"))
    hits = rows.join(F.broadcast(test) if size <= BROADCAST_BYTES else test, (F.col("k") == F.col("h")) & (F.col("cut") == F.col("gram")), "left")
    hits = hits.filter("pos = 0 OR h IS NOT NULL").select(
        "doc_id", "th", "n", "pos", F.when(F.col("pos") > 0, F.struct("pos", (F.col("pos") + F.col("len") - 1).alias("last"))).alias("span"), "items")
    per = hits.groupBy("doc_id", "th").agg(
        F.max("n").alias("n_words"), F.sum((F.col("pos") == 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))
    empty = F.expr("cast(array() as array<struct<pos:int,last:int>>)")
    spans = F.aggregate("found", empty, lambda a, x: F.when(
        (F.size(a) > 0) & (x["pos"] <= F.try_element_at(a, F.lit(-1))["last"] + 1),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(a, F.lit(-1))["pos"].alias("pos"), F.greatest(x["last"], F.try_element_at(a, F.lit(-1))["last"]).alias("last")))),
    ).otherwise(F.concat(a, F.array(x))))
    per = per.withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["last"] - x["pos"] + 1)
    per = per.select("*", n_hit.cast("long").alias("n_hit"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return per.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are not contaminated; rows with a null id stay."""
    bad = scan(docs, items).filter("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


#: The contract's columns in DuckDB.
SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS l, w[i:i + least(len(w), 13) - 1] AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM grams),
cuts AS (
  SELECT doc_id, i, l, w[i:i + l - 1] AS gram
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
hits AS (SELECT c.doc_id, c.i, c.l, g.item FROM cuts c JOIN grams g ON c.l = g.l AND c.gram = g.gram),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
