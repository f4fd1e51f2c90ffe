"""Encoding and decoding against the sentencepiece library itself."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from helpers import docs_of

from fairlane.llm import sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = list("abcdethe AEI  ▁▁\n\t.,!éüñçß漢字あ한 ٠ع\x00\x7f🙂𝒳️ﬁ<s>0x41'\"-_=#²\r")


def ids_of(table, text):
    import numpy as np
    return np.frombuffer(table.encode(text), "<i4").tolist()


def test_ids_equal_the_library_on_odd_texts():
    table = sentencepieces.PieceTable(MODEL)
    rng = random.Random(11)
    pieces = [p.replace("▁", " ") for p in table.score]
    texts = ["".join(rng.choices(ODD, k=rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(3000)]
    texts += ["", " ", "  ", " " * 1000, " " * 37 + "x" + " " * 17, "a" * 5000, "▁" * 99 + " x", "\n" * 50, "aaaaab" * 200, "漢" * 300 + "the"]
    for t in texts:
        assert ids_of(table, t) == table.model.encode(t), t


def test_without_borders_the_table_is_the_same():
    """Whole texts as one stretch: the borders read off the vocabulary change nothing."""
    import re
    table, plain = sentencepieces.PieceTable(MODEL), sentencepieces.PieceTable(MODEL)
    plain.word = re.compile("(?s:.+)")
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choices(ODD, k=80))
        assert ids_of(table, t) == ids_of(plain, t)


def test_neighbours_are_compatible_and_pairs_decide():
    table = sentencepieces.PieceTable(MODEL)
    pieces = table.model.encode("▁unbelievable stories, retold", out_type=str)
    assert all(table.compatible(a, b) for a, b in zip(pieces, pieces[1:]))
    assert not table.compatible("▁t", "he")          # would be one piece
    assert table.last_pieces("▁the")[3] == "▁the" and table.last_pieces("▁the")[:2] == ["▁", "▁t"]


def test_query_digests_nulls_repeats_and_clashing_columns(spark):
    texts = {1: "One two, three.\n\nFour  five ", 2: None, 3: "", 4: " ", 5: "One two, three.", 6: "x" * 70000 + " the end", 7: "🙂 zwölf"}
    docs = docs_of(spark, texts, extra=True)
    docs = docs.unionByName(docs.filter("doc_id = 5"))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, sentencepieces.digests(sentencepieces.encode(docs, MODEL, with_decoded=True)).collect()))
    want = []
    for i, t in [*texts.items(), (5, texts[5])]:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_round_trip_and_empty_table(spark):
    docs = docs_of(spark, {1: "a b\nc", 2: None, 3: "  lead"})
    encoded = sentencepieces.encode(docs, MODEL)
    assert dict(map(tuple, sentencepieces.decode(encoded, MODEL).collect())) == {1: "a b\nc", 2: "", 3: "  lead"}
    assert sentencepieces.digests(sentencepieces.encode(docs.limit(0), MODEL, with_decoded=True)).collect() == []
