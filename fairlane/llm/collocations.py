"""Phrase collocation mining by top-order marginalisation.

Every word starts one window: itself and its next two words in the piece, as
lead columns (the piece's word array shifted by one and two); at the end of a
piece the window is shorter. Only these longest windows are counted. A ROLLUP
over the counted windows' columns (lang, w1, w2) then sums them to the
frequencies of word pairs, words and languages, so no n-gram length is
exploded or counted from the texts a second time.

A part of a phrase is at least as frequent as the phrase, so what the scores
need are rows of ``least`` occurrences or more: one small table. Counts are
summed map-side before each shuffle, so a very common word or window is one
row per task; windows are dealt by their whole text, not by their first
words. The last ranking keeps the best ``top`` rows of a language in each
task before the shuffle (a row-number limit).

Null texts are empty, null langs count as ``und`` (with rows of that lang),
texts of separators only have no words. Repeated rows count each time. Texts
are cut into pieces before anything else, so a very long text is never an
array of windows. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlane.llm.common import keep

LONGEST = 3


def windows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, w1, w2, w3) of every word: the word and its next two in the piece, null past its end."""
    folded = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    pieces = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(folded, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = pieces.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).filter("piece <> ''").select("lang", F.split("piece", r"[ \t]+").alias("w"))
    shifted = [F.col("w"), *(F.slice("w", k, F.size("w")) for k in range(2, LONGEST + 1))]
    return words.select("lang", F.inline(F.arrays_zip(*shifted))).toDF("lang", "w1", "w2", "w3")


def phrase_counts(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, phrase, k, f): phrases of k = 1 to 3 words that occur ``least`` times or more in their language,
    and with k = 0 and an empty phrase the number of all its words."""
    counted = windows(docs).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("window")).groupBy("lang", "window").agg(F.count("*").alias("f"))
    counted = keep(counted, "phrase-windows")           # read twice; the shuffle above goes once it is written
    w = F.split("window", " ")
    tops = counted.select("lang", "f", "window", w[0].alias("w1"), F.coalesce(F.get(w, F.lit(1)), F.lit("")).alias("w2"), F.size(w).alias("k"))
    # after the rollup a null is a summed column, "" the end of a piece
    sums = tops.rollup("lang", "w1", "w2").agg(F.sum("f").alias("f")).filter("lang IS NOT NULL AND (w1 IS NULL OR f >= %d) AND (w2 IS NULL OR w2 <> '')" % least)
    k = F.when(F.col("w1").isNull(), 0).when(F.col("w2").isNull(), 1).otherwise(2)
    return sums.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), k.alias("k"), "f").unionByName(
        tops.filter(f"k = {LONGEST} AND f >= {least}").select("lang", F.col("window").alias("phrase"), "k", "f"))


def _joined(words: Column, start: int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Candidates are phrases of two or three words with a = f(phrase) >=
    ``least``. A cut after the first k words gives l and r, the frequencies
    of both parts, and the score floor(10^6 a^2 / (l r)); the lowest score
    counts, of equals the smallest k. Candidates inside a longer candidate of
    at least ``inside`` per cent of their frequency are dropped. Order: score
    and a descending, phrase ascending by bytes.
    """
    counts = keep(phrase_counts(docs, least), "phrase-counts")
    parts = counts.filter("k > 0").select("lang", "phrase", "f")
    w = F.split("phrase", " ")
    cands = counts.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", w.alias("w"))
    cuts = cands.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _joined(F.col("w"), 1, F.col("cut")).alias("left"),
        F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("right"))
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    # whole decimals of up to 38 digits, divided without a fraction
    score = F.expr("(1000000 * (CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    longer = cands.filter(f"k = {LONGEST}").select("lang", "a", F.explode(F.array(_joined(F.col("w"), 1, 2), _joined(F.col("w"), 2, 2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    ranked = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    for share in ([F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))], []):
        order = Window.partitionBy("lang", *share).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang,
         list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (VALUES (1), (2), (3)) AS s(k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
longer AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE o = 1 AND (m IS NULL OR 100 * m < 50 * a))
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
