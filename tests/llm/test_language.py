import random

from helpers import DOCS

from fairlane.llm import language

SYLLABLES = {"aa": "ba do ki ru ma lo", "bb": "schnu ber gen hei ung", "cc": "é tion eau oux çon", "dd": "日 本 語 文 字"}


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 40))), lang, "s", 0))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    train = spark.createDataFrame(rows(1, 300), DOCS)
    test = rows(2, 200)
    long_text = " ".join(["eauoux"] * 30000)
    odd = [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "12 %% 3", None, None, 0), (1003, long_text, None, None, 0), (1003, long_text, None, None, 0), (None, "ba do", None, None, 0)]
    df = spark.createDataFrame(test + odd, DOCS).withColumnRenamed("lang", "lang_pred").withColumnRenamed("n_chars", "score")
    got = language.identify(df, language.fit(train)).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(test) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(by[i][0] == lang for i, _, lang, _, _ in test) >= 0.97 * len(test)
    assert [by[i][0] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]


def test_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, None, 0)], DOCS)
    assert language.fit(df) is None and language.fit(df.limit(0)) is None
    assert [tuple(r) for r in language.identify(df, None).collect()] == [(1, "und", 0.0)]
    one = language.fit(spark.createDataFrame([(1, "abc", "x", None, 0)], DOCS))
    assert [r["lang_pred"] for r in language.identify(df, one).collect()] == ["x"]


def test_scores_equal_the_kernel_written_out():
    import numpy as np

    kernel = language.Kernel(["a", "b"], np.random.default_rng(0).normal(size=(1 << language.BITS, 2)), np.array([0.1, -0.1]))
    texts = [b"abcabd", b"", b"zz", "é tion".encode()]
    grams = [language.present(np.frombuffer(t, np.uint8)) for t in texts]
    want = [kernel.weights[g].sum(0) / np.sqrt(max(1, len(g))) + kernel.bias for g in grams]
    assert np.allclose(kernel.scores(grams), want)
    assert len(grams[0]) == len({t[i:i + n] for t in (b"abcabd",) for n in language.GRAMS for i in range(len(t) - n + 1)})


def test_the_sample_is_bounded_over_many_languages(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 + f"{i % 40:02d}" for _ in range(12)), f"l{i % 40:02d}", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    assert len(language.fit(docs).langs) == 40
    few = language.fit(docs, languages=7, rows_in_all=20)
    assert few.langs == [f"l{i:02d}" for i in range(7)]             # ties by name
