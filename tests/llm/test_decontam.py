import hashlib
import random
import re

from helpers import DOCS, docs_of, words

from fairlane.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    grams = {}
    for i, t in items.items():
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = set()
    for d, t in texts.items():
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        ids = ",".join(sorted(found))
        out.add((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_scan_equals_brute_force(spark):
    rng = random.Random(7)
    items = {i: " ".join(words(rng, rng.choice((3, 12, 13, 14, 40)))) for i in range(30)} | {98: None, 99: "", 100: "Ünï Zwei"}
    texts = {}
    for d in range(120):
        w = words(rng, rng.randrange(200))
        for _ in range(rng.randrange(4)):
            g = items[rng.randrange(30)].split()
            a = rng.randrange(len(g))
            at = rng.randrange(len(w) + 1)
            w[at:at] = g[a:a + rng.randrange(1, 41)]
        texts[d] = rng.choice((" ", ", ", "\n")).join(x.upper() if rng.random() < 0.2 else x for x in w)
    texts |= {200: None, 201: "", 202: "ünï ZWEI Ünï zwei", 203: " ".join([items[3]] * 400 + words(rng, 20000))}
    got = decontam.scan(docs_of(spark, texts, extra=True), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {tuple(r)[:6] for r in got.drop("spans").collect()} == brute(texts, items)
    for r in got.collect():
        assert sum(b - a + 1 for a, b in r["spans"]) == r["n_hit"]
    bad = {d for d, *_, c in brute(texts, items) if c}
    df = docs_of(spark, texts, extra=True)
    left = decontam.drop_contaminated(df, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(texts) - bad


def test_empty_tables_repeated_rows_and_null_id(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 1), (1, "a b", None, None, 1), (None, "a b", None, None, 1)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontam.scan(df, none).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(5, "A b")], "item_id long, text string")
    assert [r["contaminated"] for r in decontam.scan(df, one).collect()] == [True] * 3
    assert decontam.scan(df.limit(0), one).count() == 0
    assert [r["doc_id"] for r in decontam.drop_contaminated(df, one).collect()] == [None]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 1)], DOCS)
    one = spark.createDataFrame([(5, "A b")], "item_id long, text string")
    plan = decontam.scan(df, one)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
