import random

from helpers import Groups, docs_of, words

from fairlane.llm import paragraphs


def brute(texts):
    """(doc_id, first word, last word) of every paragraph that an earlier document has; paragraphs are cut here, at line feeds."""
    units = []
    for d, text in texts.items():
        at = 0
        for line in text.split("\n"):
            w = line.split()
            units.append((d, at, at + len(w) - 1, {tuple(w[i:i + 5]) for i in range(len(w) - 4)}))
            at += len(w)
    g = Groups(range(len(units)))
    for a in range(len(units)):
        for b in range(a):
            if 100 * len(units[a][3] & units[b][3]) >= 80 * len(units[a][3] | units[b][3]):
                g.join(a, b)
    kept = {}
    for k, u in enumerate(units):
        kept[g.find(k)] = min(kept.get(g.find(k), u[0]), u[0])
    return {(u[0], u[1], u[2], kept[g.find(k)]) for k, u in enumerate(units) if kept[g.find(k)] != u[0]}


def passages(spark, texts):
    rows = paragraphs.repeated_passages(docs_of(spark, texts, extra=True).repartition(3, "doc_id"), extend=True).collect()
    return {(r["doc_id"], r["first_word"], r["last_word"], r["kept_doc_id"]) for r in rows}


def test_long_paragraphs_go_whole_as_copies_and_near_copies(spark):
    rng = random.Random(4)
    texts = {}
    for k, n in enumerate((40, 41, 43, 51, 60, 80, 100, 100, 120, 120)):
        w = words(rng, n)
        near = list(w)
        if n == 40:
            near.append("appended")         # one word more than LONG
        elif k % 2:
            near[n // 2] = "changed"        # the similarity is 0.8 or more from 51 words on
        for i, mine in enumerate((w, w, near)):
            texts[100 * i + k] = "\n".join(" ".join(x) for x in (words(rng, 30), mine, words(rng, 30)))
    want = brute(texts)
    assert len(want) == 19
    assert passages(spark, texts) == want


def test_passages_inside_long_paragraphs_are_cut_to_the_last_common_word(spark):
    rng = random.Random(12)
    texts = {i: words(rng, 200) for i in range(40)}
    want = set()
    for k, n in enumerate((43, 51, 60, 80, 150)):
        passage = words(rng, n)
        for i in (k, k + 10, k + 20):
            at = rng.randrange(1, 200)
            texts[i][at:at] = passage
            if i != k:
                want.add((i, at, at + n - 1, k))
    got = passages(spark, {i: " ".join(w) for i, w in texts.items()})
    assert [(g[0], g[3]) for g in sorted(got)] == [(w[0], w[3]) for w in sorted(want)]
    for g, w in zip(sorted(got), sorted(want)):      # a window with one other word at its edge is a near copy
        assert w[1] - 1 <= g[1] <= w[1] and w[2] <= g[2] <= w[2] + 1
