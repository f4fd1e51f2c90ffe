import random

import numpy as np
import pyarrow as pa
from helpers import docs_of, words

from fairlane.llm import paragraphs


def chunk_of(texts):
    return pa.RecordBatch.from_pydict({"text": texts}, schema=pa.schema([("text", pa.string())]))


def texts_of(rng):
    line = words(rng, 12)
    varied = [" ".join(line[:k] + ["other"] + line[k + 1:]) for k in range(12)]
    return [" ".join(words(rng, 400)), "\n".join(varied), None, "", " ".join(["same"] * 50 + words(rng, 60)), " ".join(line), "\n".join(f"{' '.join(words(rng, 30))} {k % 2}" for k in range(20))]


def test_links_within_a_text_equal_brute_force():
    chunk = chunk_of(texts_of(random.Random(3)))
    text, _, _, sh, off, ids = paragraphs._units(chunk)
    keys = np.stack(paragraphs._band_keys(sh, off), 1)
    want = set()
    for a in range(len(ids)):
        for b in range(a):
            if text[a] == text[b] and ids[a] != ids[b] and (keys[a] == keys[b]).any():
                x, y = (set(sh[off[k]:off[k + 1]].tolist()) for k in (a, b))
                if 100 * len(x & y) >= 80 * len(x | y):
                    want.add((min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))))
    _, _, (x, y) = paragraphs._met(chunk, 80)
    assert want and set(zip(x.tolist(), y.tolist())) == want


def test_pairs_compared_in_slices_are_the_same(monkeypatch):
    chunk = chunk_of(texts_of(random.Random(4)))
    whole = paragraphs._met(chunk, 80)[2]
    monkeypatch.setattr(paragraphs, "PAIR_TOKENS", 1)
    assert all((a == b).all() for a, b in zip(whole, paragraphs._met(chunk, 80)[2]))


def test_lists_and_links_of_the_collisions_hold_every_colliding_pair(spark, monkeypatch):
    texts = [t for seed in range(4) for t in texts_of(random.Random(seed))]
    texts += [t and t.replace(t.split()[5], "changed", 1) for t in texts]
    chunk = chunk_of(texts)
    _, _, _, sh, off, ids = paragraphs._units(chunk)
    ids = ids.view(np.int64)
    want = set()
    for key in paragraphs._band_keys(sh, off):
        for k in np.unique(key):
            met = np.unique(ids[key == k]).tolist()
            want |= {(a, b) for a in met for b in met if a < b}
    sets = {i: set(sh[off[k]:off[k + 1]].tolist()) for k, i in enumerate(ids.tolist())}
    want = {(a, b) for a, b in want if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for group in (16, 3):
        monkeypatch.setattr(paragraphs, "GROUP", group)
        docs = docs_of(spark, dict(enumerate(texts))).coalesce(1)
        bands = paragraphs._bands(docs, 8, 80).toArrow()
        found, lists = set(), {}
        for b in set(bands["bucket"].to_pylist()):
            out = paragraphs._collisions(bands.filter(pa.compute.equal(bands["bucket"], b)))
            for key, i, linked in zip(*(out[c].to_pylist() for c in ("key", "id", "linked"))):
                if linked:
                    found.add((min(key, i), max(key, i)))
                else:
                    lists.setdefault(key, set()).add(i)
        assert found <= want
        assert all(len(x) > 1 for x in lists.values())
        assert want == found | {p for p in want if any({*p} <= x for x in lists.values())}


def test_neighbouring_windows_of_a_text_reach_no_list(spark, monkeypatch):
    listed = []

    def cluster(postings, *args, **more):
        listed.append(postings.count())
        return old(postings, *args, **more)

    old = paragraphs.cluster
    monkeypatch.setattr(paragraphs, "cluster", cluster)
    rng = random.Random(8)
    texts = {i: " ".join(words(rng, 2000)) for i in range(3)}
    texts[3] = texts[0]
    rows = paragraphs.repeated_passages(docs_of(spark, texts)).collect()
    assert listed == [0]
    assert [(r["doc_id"], r["first_word"], r["last_word"], r["kept_doc_id"]) for r in rows] == [(3, 0, 1999, 0)]


def test_texts_are_shuffled_for_one_side_at_a_time(spark, tmp_path):
    rng = random.Random(9)
    shared = " ".join(words(rng, 80))
    docs_of(spark, {i: " ".join(words(rng, 60)) + " " + shared + " " + " ".join(words(rng, 60)) for i in range(6)}).write.parquet(str(tmp_path / "docs"))
    out = paragraphs.repeated_passages(spark.read.parquet(str(tmp_path / "docs")), extend=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("n_chars#") <= 1
    assert {(r["doc_id"], r["first_word"], r["last_word"]) for r in out.collect()} == {(i, 60, 139) for i in range(1, 6)}


def test_runs_of_equal_windows_equal_those_of_one_link_at_a_time():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x = [rng.integers(1, 4, int(rng.integers(30, 400))).astype(np.uint64) for _ in range(4)]
        y = [t.copy() for t in x]
        for t in y:
            t[rng.integers(0, len(t), 3)] = 9
        y = [np.concatenate((np.full(int(rng.integers(0, 5)), 7, np.uint64), t))[:int(rng.integers(25, 400))] for t in y]
        x_off, y_off = (np.concatenate(([0], np.cumsum([len(t) for t in v]))) for v in (x, y))
        row = np.sort(rng.integers(0, 4, 60))
        a = np.array([rng.integers(0, len(x[r]) - 20) for r in row])
        b = np.maximum(0, np.minimum(a + rng.integers(-2, 6, 60), np.array([len(y[r]) for r in row]) - 20))
        n = np.full(60, 20)
        link, at, size, equal = paragraphs._equal_runs(np.concatenate(x), x_off, np.concatenate(y), y_off, row, a, n, b, n)
        want = []
        for r in range(4):
            done = {}
            for k in sorted(np.flatnonzero((row == r) & equal).tolist(), key=lambda k: a[k]):
                s, e = done.get(b[k] - a[k], (0, -1))
                if not (s <= a[k] and a[k] + 19 <= e):
                    done[b[k] - a[k]] = run = paragraphs._common_run(x[r], y[r], int(a[k]), 20, int(b[k]), 20)
                    want.append((k, run[0], run[1] - run[0] + 1))
        assert sorted(zip(link.tolist(), at.tolist(), size.tolist())) == sorted(want)
        assert equal.tolist() == [np.array_equal(x[r][i:i + 20], y[r][j:j + 20]) for r, i, j in zip(row, a, b)]
