"""Collocations against a count of every phrase in plain Python."""

import random
import re
from collections import Counter

from helpers import DOCS, docs_of
from pyspark.sql import functions as F

from fairlane.llm import collocations


def brute(rows, least=10, inside=50, top=2000):
    f, out = Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    for lang in {x for x, _ in f}:
        n = sum(c for (x, p), c in f.items() if x == lang and len(p) == 1)
        cands = {p: c for (x, p), c in f.items() if x == lang and len(p) > 1 and c >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * c >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, c in cands.items()):
                continue
            s, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def texts(seed=4, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choices(["New", "york", "city", "the", "of", "éa", "Ä", "x|y", "b"], [4, 4, 3, 6, 6, 2, 2, 1, 1], k=rng.randrange(40))
        out.append((rng.choice(["en", "de", None, "und"]), "".join(x + rng.choice([" ", " ", "\t ", ". ", "\n", ",", "\x0c"]) for x in w)))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, l, "s", 0) for i, (l, t) in enumerate(rows)], DOCS)
    return sorted(map(tuple, collocations.collocations(df, **kw).collect()))


def test_equals_counting_every_phrase(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least=3, inside=80, top=7) == brute(rows, 3, 80, 7)


def test_repeats_overlaps_nulls_and_separators(spark):
    rows = [("en", "a a a a"), ("en", "a a a a"), ("en", None), (None, "  \t "), ("en", ".,;"), ("fr", "a b" * 30), ("fr", "q" * 9000 + " b")]
    assert run(spark, rows, least=2) == brute(rows, 2)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = docs_of(spark, {i: "the big house" for i in range(12)}, extra=True).withColumn("phrase", F.lit(1))
    assert [tuple(r) for r in collocations.collocations(df).collect()] == [("en", 1, "the big house", 12, 12, 12, 36, 1000000)]


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 10**15 + 7, 3 * 10**15 + 1, 10**15 + 9
    e = "(1000000 * (CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(e + " AS s").first().s
    assert got == 1000000 * a * a // (l * r)
