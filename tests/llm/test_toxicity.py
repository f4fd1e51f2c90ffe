import itertools
import math
import random
import zlib

import numpy as np
from helpers import DOCS, words

from fairlane.llm import toxicity

BAD = ("grumbel", "snorkt", "vexilor", "plumbast")


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    common = words(rng, 300)
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(common, k=rng.randrange(1, 120))
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(BAD) + rng.choice(("", "en", "ish", ",")))
        docs.append((i, " ".join(w), None, None, 0))
        if rng.random() < 0.9:
            labels.append((i, 1, toxic))
        docs[-1] = (*docs[-1][:2], None, str(toxic), 0)
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predictions(df.withColumnRenamed("source", "score"), lab).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = {i: int(s) for i, _, _, s, _ in docs}
    out = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in out) >= 0.95 * len(out)
    left = toxicity.drop_toxic(df, lab)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, q, t ^ (zlib.crc32(str(i).encode()) % 4 == 2)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.predictions(df, flipped).collect()} == {i: r["score"] for i, r in got.items()}


def field():
    node = np.array([-0.3, 0.1, 0.4, 0.8, 1.2, 1.7, 2.2, 3.0])
    return toxicity.Field({"bad": 6.0, "^mea": 0.7, "odd$": 2.5}, node, np.array([[0.6, -0.9], [-0.4, 0.5]]), np.array([-3.0, 4.0, 1.0]))


def test_marginals_equal_the_sum_over_all_paths():
    f, rng = field(), random.Random(3)
    tagger = toxicity.Tagger(f)
    for _ in range(60):
        w = [rng.choice(("bad", "meaning", "podd", "plain", "other", "one")) for _ in range(rng.randrange(9))]
        s = [tagger.strength(x) for x in w]
        total, marked = 0.0, np.zeros(len(w))
        for path in itertools.product((0, 1), repeat=len(w)):
            p = math.exp(sum(f.move[a, b] + b * f.node[z] for a, b, z in zip((0, *path), path, s)))
            total += p
            marked += p * np.array(path, float)
        got = tagger.marginals(w)
        assert [i for i, _ in got] == [i for i, z in enumerate(s) if z]
        assert all(abs(p - marked[i] / total) < 1e-9 for i, p in got)


def test_spans_nulls_repeats_long_text_and_empty_table(spark):
    f = field()
    f.node[7] = 9.0
    text = "So BAD, really. " + "plain " * 50000 + "bad"
    df = spark.createDataFrame([(1, text, None, None, 0), (1, text, None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (None, "x", None, None, 0)], DOCS)
    got = toxicity.tag(df.withColumnRenamed("lang", "spans"), f).collect()
    assert [[text[s["start"]:s["end"]] for s in r["spans"]] for r in got if r["doc_id"] == 1] == [["BAD", "bad"]] * 2
    assert len({r["score"] for r in got if r["doc_id"] != 1}) == 1
    assert toxicity.tag(df.limit(0), f).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.predictions(df, none).collect()] == [0.5]
    one = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.predictions(df, one).collect()] == [0]


def test_offsets_hold_where_lower_case_is_longer(spark):
    docs, labels = corpus()
    docs = spark.createDataFrame(docs, DOCS)
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "İstanbul İİ place " + " ".join(BAD) + " here"
    assert len(text.lower()) > len(text)
    row = toxicity.tag(spark.createDataFrame([(1, text, None, None, 0)], DOCS), field).first()
    assert {text[s["start"]:s["end"]] for s in row["spans"]} == set(BAD)
