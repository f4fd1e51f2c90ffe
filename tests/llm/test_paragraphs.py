import random

import pyarrow as pa
from helpers import DOCS, Groups, docs_of, words

from fairlane.llm import paragraphs


def brute(texts, passage=paragraphs.PASSAGE):
    """Removed runs by comparing every two paragraphs; cuts are taken from the operator."""
    units = []
    batch = pa.RecordBatch.from_pydict({"text": list(texts.values())}, schema=pa.schema([("text", pa.string())]))
    ids = list(texts)
    text, first, n, sh, off, _ = paragraphs._units(batch)
    for k in range(len(n)):
        units.append((ids[text[k]], int(first[k]), int(n[k]), frozenset(sh[off[k]:off[k + 1]].tolist())))
    g = Groups(range(len(units)))
    for a in range(len(units)):
        for b in range(a):
            both = len(units[a][3] & units[b][3])
            if 100 * both >= 80 * (len(units[a][3]) + len(units[b][3]) - both):
                g.join(a, b)
    kept = {}
    for k, u in enumerate(units):
        kept[g.find(k)] = min(kept.get(g.find(k), u[0]), u[0])
    runs = []
    for d in sorted(texts):
        mine = sorted((u[1], u[2], kept[g.find(k)]) for k, u in enumerate(units) if u[0] == d and kept[g.find(k)] != d)
        for at, m, keep in mine:
            if runs and runs[-1][0] == d and at - runs[-1][2] <= paragraphs.MIN_WORDS:
                runs[-1][2], runs[-1][3] = max(runs[-1][2], at + m - 1), runs[-1][3] + 1
                runs[-1][4] = min(runs[-1][4], keep)
            else:
                runs.append([d, at, at + m - 1, 1, keep])
    return {(d, s, e, e - s + 1, c, k) for d, s, e, c, k in runs if e - s + 1 >= passage}


def corpus(seed=6):
    rng = random.Random(seed)

    def prose(n):
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words(rng, n))

    shared = [prose(60) for _ in range(4)]
    texts = {}
    for i in range(60):
        body = [prose(rng.randrange(5, 80)) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), rng.choice(shared))
        elif i % 3 == 1:
            w = rng.choice(shared).split()
            w[rng.randrange(60)] = "changed"
            body[0] += " " + " ".join(w) + " " + prose(10)
        texts[i] = "\n".join(body)
    texts[60], texts[61] = texts[2], texts[2] + "\nand more"
    return texts


def test_passages_equal_brute_force(spark):
    texts = corpus()
    got = [tuple(r) for r in paragraphs.repeated_passages(docs_of(spark, texts, extra=True).repartition(3, "doc_id")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(texts)


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(12)
    texts = {i: " ".join(words(rng, 200)) for i in range(100)}
    passage = " ".join(words(rng, 51))
    for i in range(40, 60):
        w = texts[i].split()
        at = rng.randrange(len(w))
        texts[i] = " ".join(w[:at]) + " " + passage + " " + " ".join(w[at:])
    got = paragraphs.repeated_passages(docs_of(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == set(range(41, 60)) and {r["kept_doc_id"] for r in got} == {40}


def test_nulls_repeated_rows_long_text_and_empty_table(spark):
    rng = random.Random(1)
    text = " ".join(words(rng, 20000))
    df = spark.createDataFrame([(1, text, None, None, 1), (1, text, None, None, 1), (2, None, None, None, 1), (3, "", None, None, 1), (4, text, None, None, 1)], DOCS)
    got = [tuple(r) for r in paragraphs.repeated_passages(df).collect()]
    assert {(r[0], r[5]) for r in got} == {(4, 1)} and sum(r[3] for r in got) > 19000
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0
