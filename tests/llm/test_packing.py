import random
import zlib

import numpy as np
import public_tokenizers
from helpers import DOCS, docs_of, words

from fairlane.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_parts_give_the_same_ids_as_whole_texts():
    import pyarrow as pa

    from fairlane.llm.common import bytes_of

    rng = random.Random(3)
    alphabet = "ab'.,<|>s tdZ9é\n$_…Σ́İ\x0b\x85"
    texts = ["<|endoftext|> Hi <|ENDOFTEXT|> it's we'll .'s don't. 日本 \U0001f600 1.5e10", None, ""]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(800)]
    ids, off = packing._Encoder(PATH).texts(*bytes_of(pa.array(texts)), 1)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [expected(t) for t in texts]


def check(rows, texts, window):
    ids = {i: expected(t) for i, t in texts.items()}
    seen = {i: [] for i in texts}
    filled: dict = {}
    for r in rows:
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert part == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == len(ids[i])
    total = sum(map(len, ids.values()))
    assert sorted(filled) == list(range(-(-total // window)))
    for k, parts in filled.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == (window if k < max(filled) else total - window * max(filled))


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(4)
    texts = {i: " ".join(words(rng, rng.randrange(120))) for i in range(80)} | {80: None, 81: "", 82: " ".join(words(rng, 6000))}
    df = docs_of(spark, texts, extra=True).repartition(5, "doc_id")
    for window in (64, 2048):
        rows = packing.pack(df, PATH, window=window).collect()
        check(rows, texts, window)
    pieces = packing.pack(df, PATH, window=64)
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.digests(pieces).collect()} == {
        (r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in pieces.collect()}
    whole = packing.sequences(pieces)
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole.collect())


def test_empty_table_repeated_rows_and_null_id(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 1), (1, "a b", None, None, 1), (None, "c", None, None, 1)], DOCS)
    rows = packing.pack(df, PATH).collect()
    assert sum(r["length"] for r in rows) == 2 * len(expected("a b")) + len(expected("c"))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_a_tokenizer_that_cuts_elsewhere_encodes_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert packing._Encoder(PATH).by_parts and not packing._Encoder(path).by_parts
    texts = {1: "A b,c  D's\n\nX", 2: None, 3: "", 4: "é 漢字 <end>"}
    got = {}
    for r in packing.pack(docs_of(spark, texts), path, window=4).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in got.items()} == {
        i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
