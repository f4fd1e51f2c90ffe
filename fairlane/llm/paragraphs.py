"""Substring dedup: MinHash banding of paragraphs.

Texts are cut into paragraphs at line feeds; a line of fewer than
``MIN_WORDS`` words belongs to the one before. Every paragraph of that many
words is looked at as a whole. One of more than ``LONG`` words is also looked
at through windows of ``WINDOW`` words that start where its text says so: at
the smallest hash of every ``SPREAD`` consecutive 5-word shingles. A passage
of WINDOW + SPREAD - 1 words or more that stands inside long paragraphs
therefore has a window in common wherever it stands.

Paragraphs and windows ("units" from here on) with equal shingles are one
class. ``BANDS`` bands of ``ROWS`` minima each collide with probability
1 - (1 - J^ROWS)^BANDS: 0.986 at Jaccard J = 0.8 and 0.9996 at 0.9. Colliding
classes are verified by the exact Jaccard similarity of their 5-word shingles
(0.8 or more) and clustered by components: those of one text where it is cut,
the others by ``links.cluster``, without all pairs of a bucket. Of each
cluster the units of the first document stay; those of later documents are
removed where they make up a passage of ``PASSAGE`` words or more. Where a
window goes but not its whole paragraph, the passage is extended word by word
to the whole run that both texts have in common there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import U64, bytes_of, chunks, keep, long, mix, parts_for, prepare, set_hash, text_bytes, word_hashes, word_spans
from fairlane.llm.links import cluster, sketches

WORDS = 5
MIN_WORDS, LONG, WINDOW, SPREAD = 8, 40, 20, 24
BANDS, ROWS = 6, 3
PASSAGE = 20
BUCKET_BYTES = 16 << 20
GROUP = 16              # classes of one text under one key that are compared where the text is cut
PAIR_TOKENS = 1 << 19   # shingles of pairs compared at once
_SEEDS = np.random.default_rng(97).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def _window_starts(s: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words at which the windows of long paragraphs start; s are the shingle hashes, lo and n their words."""
    starts = n - WINDOW + 1
    block = np.repeat(np.arange(len(lo)), starts)
    first = np.concatenate(([0], np.cumsum(starts)[:-1])).astype(np.int64)
    at = np.arange(starts.sum()) - np.repeat(first - lo, starts)
    h, picks = s[at], [np.zeros(0, np.int64)]
    step = 1 << 18
    for i in range(0, max(0, len(h) - SPREAD + 1), step):
        view = np.lib.stride_tricks.sliding_window_view(h[i:i + step + SPREAD - 1], SPREAD)
        best = view.argmin(1) + np.arange(i, i + len(view))
        whole = block[i:i + len(view)] == block[i + SPREAD - 1:i + len(view) + SPREAD - 1]
        picks.append(np.unique(best[whole]))
    few = np.flatnonzero(starts < SPREAD)
    picks.append(np.array([first[i] + h[first[i]:first[i] + starts[i]].argmin() for i in few], np.int64))
    return at[np.unique(np.concatenate(picks))]


def _units(chunk):
    """Units of a chunk: (text number, first word in its text, words, shingles, offsets, class); equal shingles may repeat in a unit."""
    return _cut(chunk)[:6]


def _cut(chunk):
    """``_units``, and for each window the first word of its paragraph in its text (-1: a whole paragraph)."""
    data, off = bytes_of(chunk.column("text"))
    start, end, text = word_spans(data, off)
    h = word_hashes(data, start, end)
    z = np.zeros(0, np.int64)
    if len(h) < WORDS:
        return z, z, z, np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, U64), z
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - WORDS + 1, U64)
        for j in range(WORDS):
            s = s * U64(0xD6E8FEB86659FD93) + h[j:j + len(s)]
        s = mix(s)
    line = np.searchsorted(np.flatnonzero(data == 10), start, "right") + text
    lo = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    new_text = np.concatenate(([True], text[lo][1:] != text[lo][:-1]))
    lo = lo[(np.diff(np.append(lo, len(h))) >= MIN_WORDS) | new_text]
    n = np.diff(np.append(lo, len(h)))
    whole = n >= MIN_WORDS
    windows = _window_starts(s, lo[n > LONG], n[n > LONG])
    within = lo[np.searchsorted(lo, windows, "right") - 1]
    at = np.concatenate((lo[whole], windows))
    n = np.concatenate((n[whole], np.full(len(windows), WINDOW)))
    within = np.concatenate((np.full(whole.sum(), -1), within))
    order = np.argsort(at, kind="stable")
    at, n, within = at[order], n[order], within[order]
    size = n - WORDS + 1
    cut = np.concatenate(([0], np.cumsum(size)))
    sh = s[np.repeat(at - cut[:-1], size) + np.arange(cut[-1])]
    first_of_text = np.searchsorted(text, np.arange(chunk.num_rows), "left")
    first = first_of_text[text[at]]
    return text[at], at - first, n, sh, cut, set_hash(sh, cut, 3), np.where(within < 0, -1, within - first)


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, at, n, within, id): first word, number of words, paragraph (-1: itself) and class of every unit."""
    def place(batches):
        for chunk in chunks(batches):
            text, first, n, _, _, ids, within = _cut(chunk)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(within.astype(np.int32)), long(ids)],
                ["doc_id", "at", "n", "within", "id"])

    return docs.mapInArrow(place, "doc_id long, at int, n int, within int, id long")


def _distinct(sh: np.ndarray, off: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the picked units, sorted within each, and the number of the unit that each belongs to."""
    size = np.diff(off)[pick]
    own = np.repeat(np.arange(len(pick)), size)
    tok = sh[np.repeat(off[:-1][pick] - np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64), size) + np.arange(size.sum())]
    order = np.lexsort((tok, own))
    tok, own = tok[order], own[order]
    one = np.concatenate(([True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1]))) if len(tok) else np.zeros(0, bool)
    return tok[one], own[one]


def _linked(sh: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the units x[k] and y[k] are similar, by the exact Jaccard similarity of their shingles."""
    units, both = np.unique(np.concatenate((x, y)), return_inverse=True)
    x, y = both[:len(x)], both[len(x):]
    tok, own = _distinct(sh, off, units)
    n = np.bincount(own, minlength=len(units))
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(len(x), bool)
    near = np.flatnonzero(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    ends = np.cumsum(n[x[near]] + n[y[near]])
    s = 0
    while s < len(near):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIR_TOKENS, "right")))
        two = np.stack((x[near[s:e]], y[near[s:e]]), 1).ravel()
        row = np.repeat(np.arange(len(two)) // 2, n[two])
        t = tok[np.repeat(at[two] - np.concatenate(([0], np.cumsum(n[two])[:-1])), n[two]) + np.arange(n[two].sum())]
        order = np.lexsort((t, row))
        t, row = t[order], row[order]
        shared = np.bincount(row[1:][(t[1:] == t[:-1]) & (row[1:] == row[:-1])], minlength=e - s)
        out[near[s:e]] = shared * 100 >= (n[x[near[s:e]]] + n[y[near[s:e]]] - shared) * percent
        s = e
    return out


def _band_keys(sh: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Key of every unit in each band."""
    keys = []
    sh = sh ^ (sh >> U64(29))
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            k = np.full(len(off) - 1, b + 1, U64)
            for seed in _SEEDS[b * ROWS:(b + 1) * ROWS]:
                x = sh * seed
                x ^= x >> U64(32)
                k = k * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x, off[:-1])
            keys.append(mix(k))
    return keys


def _met(chunk, percent: int):
    """Classes of a chunk by band key: ((ids, keys) met alone, (ids, keys, starts) met in groups, (x, y) links of groups).

    A group is the classes of one text that share a key, ``GROUP`` at most; all
    its pairs are compared here, since most collisions are of a text's
    neighbouring windows. A class is sent once per chunk and key, or once for
    each of its groups; starts marks a group's first class.
    """
    text, _, _, sh, off, ids = _units(chunk)
    z = np.zeros(0, U64)
    if not len(ids):
        return (z, z), (z, z, np.zeros(0, bool)), (z, z)
    order = np.lexsort((ids, text))
    unit = order[np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (text[order][1:] != text[order][:-1])))]
    classes, one, inv = np.unique(ids[unit], return_index=True, return_inverse=True)
    of_text = mix(text[unit].astype(U64))
    alone, groups, pairs = [], [], [np.zeros(0, np.int64)]
    size = np.diff(off)[unit[one]]
    cut = np.concatenate(([0], np.cumsum(size)))
    for class_key in _band_keys(sh[np.repeat(off[:-1][unit[one]] - cut[:-1], size) + np.arange(cut[-1])], cut):
        key = class_key[inv]
        here = key ^ of_text
        order = np.argsort(here, kind="stable")
        start = np.concatenate(([True], here[order][1:] != here[order][:-1]))
        group = np.cumsum(start) - 1
        size = np.bincount(group)[group]
        some = np.flatnonzero((size > 1) & (size <= GROUP))
        order, start, group = order[some], start[some], group[some]
        for step in range(1, GROUP):
            k = np.flatnonzero(group[step:] == group[:-step])
            if not len(k):
                break
            i, j = order[k], order[k + step]
            pairs.append(np.minimum(i, j) * len(unit) + np.maximum(i, j))
        groups.append((classes[inv[order]], key[order], start))
        rest = np.ones(len(classes), bool)
        rest[inv[order]] = False
        alone.append((classes[rest], class_key[rest]))
    pairs = np.unique(np.concatenate(pairs))
    x, y = unit[pairs // len(unit)], unit[pairs % len(unit)]
    good = _linked(sh, off, x, y, percent)
    x, y = ids[x[good]], ids[y[good]]
    return tuple(map(np.concatenate, zip(*alone))), tuple(map(np.concatenate, zip(*groups))), (np.minimum(x, y), np.maximum(x, y))


def _bands(docs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(bucket, alone, groups, links): what ``_met`` finds in each chunk, packed by the bucket of the band key or the link."""
    def deal(present, part, columns):
        order = np.argsort(part, kind="stable")
        columns, part = [c[order] for c in columns], part[order]
        low, high = np.searchsorted(part, present, "left"), np.searchsorted(part, present, "right")
        return pa.array([b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(low, high)], pa.binary())

    def pack(batches):
        for chunk in chunks(batches):
            (own, key), (g_own, g_key, start), (x, y) = _met(chunk, percent)
            parts = [((k >> U64(32)) % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32) for k in (key, g_key, x)]
            present = np.unique(np.concatenate(parts))
            if len(present):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present.astype(np.int32)), deal(present, parts[0], (own, key.astype(np.uint32))),
                     deal(present, parts[1], (g_own, g_key.astype(np.uint32), start)), deal(present, parts[2], (x, y))], ["bucket", "alone", "groups", "links"])

    return docs.select("text").mapInArrow(pack, "bucket int, alone binary, groups binary, links binary")


def _collisions(table: pa.Table) -> pa.Table:
    """(key, id, linked): the links within texts as (x, y, true), and the keys that two classes or more have, unless one group holds all of a key's."""
    own, key, start, x, y = [], [], [], [], []
    for raw in table.column("alone").to_pylist():
        m = len(raw) // 12
        own.append(np.frombuffer(raw, U64, m))
        key.append(np.frombuffer(raw, np.uint32, m, 8 * m))
    single = sum(map(len, own))
    for raw in table.column("groups").to_pylist():
        m = len(raw) // 13
        own.append(np.frombuffer(raw, U64, m))
        key.append(np.frombuffer(raw, np.uint32, m, 8 * m))
        start.append(np.frombuffer(raw, bool, m, 12 * m))
    for raw in table.column("links").to_pylist():
        m = len(raw) // 16
        x.append(np.frombuffer(raw, U64, m))
        y.append(np.frombuffer(raw, U64, m, 8 * m))
    own, key, start, x, y = map(np.concatenate, (own, key, start, x, y))
    size = np.bincount(np.cumsum(start) - 1) if len(start) else np.zeros(0, np.int64)
    of_group = key[single:][start]
    order = np.lexsort((own, key))
    own, key = own[order], key[order]
    one = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))[:len(key)]
    own, key = own[one], key[one]
    names, inv, c = np.unique(key, return_inverse=True, return_counts=True)
    open_ = c > 1
    at = np.searchsorted(names, of_group)
    open_[at[size == c[at]]] = False
    many = open_[inv]
    full = (U64(table.column("bucket")[0].as_py()) << U64(32)) | key[many].astype(U64)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    one = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[:len(x)]
    x, y = x[one], y[one]
    return pa.Table.from_arrays([long(np.concatenate((full, x))), long(np.concatenate((own[many], y))), pa.array(np.arange(len(full) + len(x)) >= len(full))], ["key", "id", "linked"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, sketch, toks): shingles of the wanted classes, from one unit each: wanted has (doc_id, id).

    A class comes again for each row that repeats its document, which changes no link.
    """
    per = wanted.groupBy("doc_id").agg(F.collect_set("id").alias("ids")).withColumnRenamed("doc_id", "_doc")
    rows = docs.join(per, docs["doc_id"].eqNullSafe(per["_doc"])).select("text", "ids")

    def extract(batches):
        for chunk in chunks(batches):
            text, _, _, sh, off, ids = _units(chunk)
            want = [set(x) for x in chunk.column("ids").to_pylist()]
            mine = ids.view(np.int64).tolist()
            pick = []
            for i, (t, c) in enumerate(zip(text.tolist(), mine)):
                if c in want[t]:
                    want[t].remove(c)
                    pick.append(i)
            pick = np.array(pick, np.int64)
            tok, own = _distinct(sh, off, pick)
            ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(pick)))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64)[pick]), pa.array(sketches(tok, own, len(pick)), pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), long(tok))], ["id", "sketch", "toks"])

    return rows.mapInArrow(extract, "id long, sketch binary, toks array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x, y = (sets.select(F.col("id").alias(f"{s}_id"), F.col("toks").alias(f"{s}_toks")) for s in "xy")
    both = pairs.join(y, F.col("y") == F.col("y_id")).join(x, F.col("x") == F.col("x_id"))
    shared = F.size(F.array_intersect("x_toks", "y_toks"))
    return both.filter(shared * 100 >= (F.size("x_toks") + F.size("y_toks") - shared) * percent).select("x", "y")


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Number of leading words that two texts have in common."""
    at, step, most = 0, 64, min(len(x), len(y))
    while at < most:
        differ = np.flatnonzero(x[at:min(at + step, most)] != y[at:min(at + step, most)])
        if len(differ):
            return at + int(differ[0])
        at, step = min(at + step, most), 2 * step
    return most


def _common_run(x: np.ndarray, y: np.ndarray, a: int, n: int, b: int, m: int) -> tuple[int, int] | None:
    """First and last word of x in the run around x[a:a + n] that y has around y[b:b + m]; None if they share no shingle."""
    if n == m and np.array_equal(x[a:a + n], y[b:b + m]):
        hits = [(a, b)]
    else:
        of = {y[j:j + WORDS].tobytes(): j for j in range(b, min(b + m, len(y)) - WORDS + 1)}
        hits = [(i, of[k]) for i in range(a, min(a + n, len(x)) - WORDS + 1) if (k := x[i:i + WORDS].tobytes()) in of]
    if not hits:
        return None
    (i, j), (p, q) = hits[0], hits[-1]
    return min(a, i - _agree(x[:i][::-1], y[:j][::-1])), max(a + n, p + _agree(x[p:], y[q:])) - 1


def _agrees(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """For each k the number of words, ``most[k]`` at most, that x from i[k] on and y from j[k] on have in common; way -1: backwards."""
    got, live, step = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 16
    while len(live):
        k = got[live][:, None] + np.arange(step)
        inside = k < most[live][:, None]
        k = np.where(inside, k, 0) * way
        same = inside & (x[i[live][:, None] + k] == y[j[live][:, None] + k])
        run = np.where(same.all(1), step, same.argmin(1))
        got[live] += run
        live = live[(run == step) & (got[live] < most[live])]
        step = min(2 * step, max(16, (1 << 18) // max(1, len(live))))
    return got


def _equal_runs(x, x_off, y, y_off, row, a, n, b, m) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs around linked windows of equal words, sorted by row and a: (link, first word, number of words), once for each run, and which links are of equal words."""
    left, right = np.minimum(a, b), np.minimum(x_off[row + 1] - x_off[row] - a, y_off[row + 1] - y_off[row] - b)
    equal = (n == m) & (n <= right)
    i, j = x_off[row] + a, y_off[row] + b
    equal[equal] = _agrees(x, y, i[equal], j[equal], n[equal], 1) == n[equal]
    # links of one row and shift in order: each is followed to the next only, so that a run is read once
    some = np.flatnonzero(equal)
    some = some[np.lexsort((a[some], b[some] - a[some], row[some]))]
    last = np.append((row[some][1:] != row[some][:-1]) | ((b - a)[some][1:] != (b - a)[some][:-1]), True)[:len(some)]
    gap = np.where(last, right[some], np.append(np.diff(a[some]), 0)[:len(some)])
    got = _agrees(x, y, i[some], j[some], gap, 1)
    ends = last | (got < gap)
    head = np.concatenate(([True], ends[:-1]))[:len(some)]
    first = some[head]
    before = _agrees(x, y, i[first] - 1, j[first] - 1, left[first], -1)
    return first, a[first] - before, (a[some] + got)[ends] - a[first] + before, equal


def _extended(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, at, n, kept): the common runs around linked windows; links has (doc_id, at, n, kept, other: (doc_id, at, n))."""
    per = links.groupBy("doc_id", F.col("other.doc_id").alias("_other")).agg(
        F.collect_set(F.struct("at", "n", F.col("other.at").alias("b"), F.col("other.n").alias("m"), F.col("kept.doc_id").alias("kept"))).alias("links"))
    rows = per.withColumnRenamed("doc_id", "_doc").join(docs, F.col("_doc").eqNullSafe(docs["doc_id"])).select("_doc", "_other", "links", "text")
    rows = keep(rows, "paragraph-texts")        # the shuffled texts go before those of the other side are shuffled
    rows = rows.join(docs.select("doc_id", F.col("text").alias("y")), F.col("_other").eqNullSafe(F.col("doc_id"))).select(F.col("_doc").alias("doc_id"), "links", "text", "y")

    def words(column):
        data, off = bytes_of(column)
        start, end, text = word_spans(data, off)
        return word_hashes(data, start, end), np.searchsorted(text, np.arange(len(column) + 1), "left")

    def extend(batches):
        for part in chunks(batches):
            for chunk in chunks([part], "y"):
                (x, x_off), (y, y_off) = words(chunk.column("text")), words(chunk.column("y"))
                found = chunk.column("links")
                row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
                found = found.flatten()
                kept = found.field("kept")
                k_at, k_n, k_b, k_m = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n", "b", "m"))
                link, at, n, equal = _equal_runs(x, x_off, y, y_off, row, k_at, k_n, k_b, k_m)
                odd = np.zeros(chunk.num_rows, bool)
                odd[row[~equal]] = True
                some = ~odd[row[link]]
                link, at, n = link[some], at[some], n[some]
                more = []
                for r in np.flatnonzero(odd).tolist():
                    mine, theirs = x[x_off[r]:x_off[r + 1]], y[y_off[r]:y_off[r + 1]]
                    done: dict[int, tuple[int, int]] = {}       # the last run of each shift
                    own = np.arange(*np.searchsorted(row, (r, r + 1)))
                    for k in own[np.argsort(k_at[own], kind="stable")].tolist():
                        a, m, b, o = int(k_at[k]), int(k_n[k]), int(k_b[k]), int(k_m[k])
                        s, e = done.get(b - a, (0, -1))
                        if s <= a and a + m - 1 <= e:
                            continue
                        run = _common_run(mine, theirs, a, m, b, o)
                        if run is not None:
                            done[b - a] = run
                            more.append((k, run[0], run[1] - run[0] + 1))
                link, at, n = np.concatenate((np.stack((link, at, n), 1), np.array(more, np.int64).reshape(-1, 3))).T
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id").take(pa.array(row[link])), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), kept.take(pa.array(link))],
                    ["doc_id", "at", "n", "kept"])

    return rows.mapInArrow(extend, "doc_id long, at int, n int, kept long")


def repeated_passages(docs: DataFrame, percent: int = 80, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", extend: bool = False) -> DataFrame:
    """One row per passage to remove: doc_id, first_word, last_word, n_words, n_units, kept_doc_id.

    Words are runs without ASCII white space, numbered from 0 in their text.
    The first document of a cluster, by id, keeps its units; kept_doc_id is
    the smallest of those that keep the passage's units. A passage is a run of removed units
    that overlap or have at most ``MIN_WORDS`` words between them; runs of
    fewer than ``passage`` words stay. With ``extend`` a removed window whose
    paragraph is not removed stands for the whole run of words around it that
    its text shares with the first other text that has the window (one of
    equal words if there is such a text). Null and empty texts have no
    paragraphs; a null id counts as the smallest, and rows that repeat an id
    are the same document, so they don't remove each other. Other columns are
    not read; an empty table gives no row.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = parts_for(text_bytes(docs), BUCKET_BYTES)
    places = keep(_places(docs), "paragraph-places")
    bands = keep(_bands(docs, buckets, percent).groupBy("bucket").applyInArrow(_collisions, "key long, id long, linked boolean"), "paragraph-bands")
    postings = bands.filter("NOT linked").select("key", "id")
    linked = bands.filter("linked").select(F.col("key").alias("x"), F.col("id").alias("y"))
    # one row per class that several documents have or that collides or is linked with another; the others take no part any more
    place = F.struct("doc_id", "at", "n")
    classes = places.groupBy("id").agg(F.min(place).alias("first"), F.max(F.struct("doc_id")).alias("last"), F.min(F.when(F.col("within") >= 0, place)).alias("own"))
    hit = bands.select("id", (~F.col("linked")).alias("hit")).union(linked.select("x", F.lit(False))).groupBy("id").agg(F.max("hit").alias("hit"))
    classes = keep(classes.join(hit, "id", "left").filter("hit IS NOT NULL OR struct(first.doc_id) <> last"), "paragraph-classes")
    sets = keep(_sets(docs, classes.filter("hit").select("id", "first.doc_id")), "paragraph-sets")
    comps = cluster(postings, sets.select("id", F.size("toks").alias("n"), "sketch"), lambda pairs: _verified(pairs, sets, percent), percent, "paragraphs", stored=True, linked=linked)
    classes = classes.withColumn("comp", F.col("id")) if comps is None else classes.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    kept = classes.groupBy("comp").agg(F.min("first").alias("kept"), F.max("last").alias("end")).filter("struct(kept.doc_id) <> end").drop("end")
    # a table of its own, so that Spark can split the rows of a very common unit in the join
    moving = keep(classes.join(kept, "comp").select("id", "kept", "own"), "paragraph-moving")
    gone = places.join(moving, "id").filter(~F.col("doc_id").eqNullSafe(F.col("kept.doc_id")))
    pieces = gone.select("doc_id", "at", "n", F.col("kept.doc_id").alias("kept"), F.lit(1).alias("c"))
    if extend:
        gone = keep(gone, "paragraph-gone")
        pieces = gone.select("doc_id", "at", "n", F.col("kept.doc_id").alias("kept"), F.lit(1).alias("c"))
        whole = gone.filter("within < 0").select(F.col("doc_id").alias("_doc"), F.col("at").alias("_at")).distinct()
        left = gone.filter("within >= 0").join(whole, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("within") == F.col("_at")), "left_anti")
        left = left.withColumn("other", F.when(F.col("own.doc_id").eqNullSafe(F.col("doc_id")), F.col("kept")).otherwise(F.col("own")))
        pieces = pieces.union(_extended(docs, left).withColumn("c", F.lit(0)))
    units = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("at", "n", "kept", "c"))).alias("units"))
    runs = F.aggregate(
        "units", F.expr("cast(array() as array<struct<at:int,last:int,units:int,kept:bigint>>)"),
        lambda a, u: F.when(
            (F.size(a) > 0) & (u["at"] - F.try_element_at(a, F.lit(-1))["last"] <= MIN_WORDS),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
                F.try_element_at(a, F.lit(-1))["at"].alias("at"), F.greatest(u["at"] + u["n"] - 1, F.try_element_at(a, F.lit(-1))["last"]).alias("last"),
                (F.try_element_at(a, F.lit(-1))["units"] + u["c"]).alias("units"), F.least(F.try_element_at(a, F.lit(-1))["kept"], u["kept"]).alias("kept")))),
        ).otherwise(F.concat(a, F.array(F.struct(u["at"].alias("at"), (u["at"] + u["n"] - 1).alias("last"), u["c"].alias("units"), u["kept"].alias("kept"))))))
    out = units.select("doc_id", F.explode(runs).alias("r"))
    return out.select("doc_id", F.col("r.at").alias("first_word"), F.col("r.last").alias("last_word"), (F.col("r.last") - F.col("r.at") + 1).alias("n_words"),
                      F.col("r.units").alias("n_units"), F.col("r.kept").alias("kept_doc_id")).filter(F.col("n_words") >= passage)
