import itertools
import random
import re

from helpers import DOCS, Groups, docs_of, words

from fairlane.llm import jaccard, links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    g = Groups(texts)
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            g.join(a, b)
    return {(i, len(sets[i]), g.find(i)) for i in texts}


def corpus(seed=5):
    rng = random.Random(seed)
    texts, passage = {}, words(rng, 40)
    for _ in range(30):
        base = words(rng, rng.randrange(3, 150))
        texts[len(texts)] = " ".join(base)
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            texts[len(texts)] = " ".join(copy)
    for _ in range(10):
        texts[len(texts)] = " ".join(passage + words(rng, rng.randrange(5, 30)))
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    got = {tuple(r) for r in jaccard.jaccard_components(docs_of(spark, texts, extra=True)).collect()}
    assert got == brute(texts)


def test_large_group_whose_members_do_not_all_link(spark):
    # every text differs from the base in its own places: many pairs lie just above or below the limit
    rng = random.Random(8)
    base = words(rng, 100)
    texts = {}
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 4)):
            copy[at] = words(rng, 1)[0]
        texts[i] = " ".join(copy)
    got = {tuple(r) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute(texts)


def test_nulls_blanks_case_copies_and_long_text(spark):
    rng = random.Random(2)
    long_text = " ".join(words(rng, 30000))
    texts = {1: None, 2: "", 3: " \n\t", 4: "One Two", 5: "one two", 6: "one", 7: long_text, 8: long_text + " end", 9: "a b c d e", 10: "A B C D E"}
    got = {tuple(r) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute(texts)


def test_repeated_rows_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c", None, None, 1), (3, "a b c", None, None, 1), (None, "a b c", None, None, 1), (None, "z", None, None, 1)], DOCS)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.jaccard_components(df).collect())
    assert got == [("3", 1, "3"), ("3", 1, "3"), ("None", 1, "3"), ("None", 1, "None")]
    assert sorted(str(r["doc_id"]) for r in jaccard.one_per_group(df).collect()) == ["3", "3", "None", "None"]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_one_per_group_keeps_smallest_id_and_columns(spark):
    texts = corpus(11)
    df = docs_of(spark, texts, extra=True)
    got = jaccard.one_per_group(df)
    assert got.columns == df.columns
    assert {r["doc_id"] for r in got.collect()} == {c for _, _, c in brute(texts)}


def test_components_of_chains(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids[:120], ids[1:120])] + [(a, b) for a, b in zip(ids[150:], ids[151:])]
    g = Groups(range(200))
    for a, b in edges:
        g.join(a, b)
    got = dict(map(tuple, links.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: g.find(i) for e in edges for i in e}
    assert links.components(spark.createDataFrame([(1, 1)], "u long, v long")) is None
