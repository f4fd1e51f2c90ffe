import random
import re

from helpers import DOCS, docs_of, words

from fairlane.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def matches(a, b):
    if a == b:
        return True
    va = {tuple(a)} | {tuple(a[:i] + a[i + 1:]) for i in range(len(a))}
    vb = {tuple(b)} | {tuple(b[:i] + b[i + 1:]) for i in range(len(b))}
    return bool(va & vb)


def brute(texts):
    all_lines = [(i, k, w) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n"))
                 if len(w := WORD.findall(line.lower())) >= lines.MIN_WORDS]
    return {(i, k) for n, (i, k, w) in enumerate(all_lines) if any(matches(w, v) for _, _, v in all_lines[:n])}


def corpus(seed=3):
    rng = random.Random(seed)
    bases = [words(rng, rng.randrange(4, 30)) for _ in range(40)]
    bases += [["the"] * 9 + [w] for w in words(rng, 3)] + [["same", "longest", "longest", "word", "here", "twice", "ok"]]

    def variant():
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            at, how = rng.randrange(len(w)), rng.randrange(4)
            if how == 0:
                w[at] = rng.choice(("x", "averyverylongword", w[0]))
            elif how == 1 and len(w) > 1:
                del w[at]
            elif how == 2:
                w.insert(at, rng.choice(("q", "extraordinarilylong")))
            else:
                w.insert(rng.randrange(len(w)), w.pop(at))
        return " ".join(w)

    return {i: "\n".join(variant() for _ in range(rng.randrange(6))) for i in range(60)}


def test_dropped_lines_equal_brute_force(spark):
    texts = corpus()
    df = docs_of(spark, texts, extra=True).repartition(4, "doc_id")
    rows = lines.duplicate_lines(df).collect()
    assert {(r["doc_id"], r["line_no"]) for r in rows} == brute(texts) and len(rows) == len(brute(texts))
    for r in rows:
        a, b = (WORD.findall(texts[d].split("\n")[k].lower()) for d, k in ((r["doc_id"], r["line_no"]), (r["kept_doc_id"], r["kept_line_no"])))
        assert matches(a, b) and (r["kept_doc_id"], r["kept_line_no"]) < (r["doc_id"], r["line_no"])


def test_texts_lose_their_dropped_lines(spark):
    texts = corpus(9) | {900: None, 901: "", 902: "short line\nshort line", 903: "\n\n"}
    df = docs_of(spark, texts, extra=True)
    gone = brute(texts)
    left = {}
    for i, t in texts.items():
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        touched = any(d == i for d, _ in gone)
        if not touched:
            left[i] = t
        elif any(x.strip() for x in kept):
            left[i] = "\n".join(kept)
    out = lines.without_duplicate_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {r["doc_id"]: r["text"] for r in got} == left
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_null_ids_repeated_rows_empty_table_and_long_lines(spark):
    rng = random.Random(1)
    line = " ".join(words(rng, 20000))
    df = spark.createDataFrame([(1, line, None, None, 1), (1, line, None, None, 1), (2, line + " more", None, None, 1), (None, "a b c d e f", None, None, 1),
                                (5, "A B C D E F", None, None, 1)], DOCS)
    got = {tuple(r) for r in lines.duplicate_lines(df).collect()}
    assert got == {(2, 0, 1, 0, True), (5, 0, None, 0, False)}
    assert lines.duplicate_lines(df.limit(0)).count() == 0
    assert lines.without_duplicate_lines(df.limit(0)).count() == 0
