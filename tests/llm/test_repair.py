"""Conversation repair against all edit sequences, and the rows against a plain version."""

import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from fairlane.llm import repair

CONVS = "conv_id long, turn long, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def all_edits(codes, most):
    """(cost, audit) of every accepted sequence of edits up to a cost."""
    def go(at, state, cost, audit):
        if cost > most:
            return
        if at == len(codes) and state in (0, 3):
            yield cost, audit
        yield from go(at, NEXT[state], cost + 5, audit + "I")
        if at < len(codes):
            c = codes[at]
            yield from go(at + 1, state, cost + 2, audit + "D")
            if c < 8:
                stay = 5 * (c >= 4)
                kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((state, c % 4))
                if kept is not None:
                    yield from go(at + 1, kept, cost + stay, audit + "K")
                yield from go(at + 1, NEXT[state], cost + stay + 1, audit + "R")
    return go(0, 0, 0, "")


def test_edits_equal_the_least_of_all_sequences():
    for n in range(4):
        for codes in itertools.product((0, 1, 2, 3, 5, 8), repeat=n):
            assert repair.cheapest_edits(bytes(codes)) == min(all_edits(codes, 2 * n)), codes
    rng = random.Random(2)
    for _ in range(150):
        codes = rng.choices((0, 0, 1, 2, 3, 4, 5, 6, 8, 17), k=rng.randrange(4, 8))
        assert repair.cheapest_edits(bytes(codes)) == min(all_edits(codes, 2 * len(codes))), codes


def test_long_conversations_stay_near_linear():
    rng = random.Random(1)
    for codes in (bytes(2000), bytes(rng.choices((0, 1, 2, 3, 5, 8), k=30000))):
        cost, audit = repair.cheapest_edits(codes)
        assert len(audit.replace("I", "")) == len(codes) and cost <= 2 * len(codes)


def plain(rows):
    """The contract over rows (conv_id, turn, role, text), conversation by conversation."""
    def known(x):
        return " " if x is None else str(x)
    out = []
    for conv in {r[0] for r in rows}:
        seq = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = known(role), known(text)
            d = zlib.crc32(f"{known(c)}:{known(turn)}".encode()) % 20
            text = "" if d == 1 else text.translate({ord(x): None for x in ".!?"}) if d == 2 else text
            role = "user" if d == 4 else role
            seq += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        digest = {(r, t): hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for _, r, t in seq}
        seq.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest[x[1:]]))
        codes, seen = [], set()
        for _, role, text in seq:
            ended = text.rstrip(repair.SPACE)
            fault = 8 if not ended else 16 if (role, text) in seen else 4 if ended[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + fault)
        cost, audit = min(all_edits(codes, 2 * len(codes)))
        turns = {t for t, _, _ in seq if t is not None}
        lines, at, state = [], 0, 0
        for e in audit:
            row = seq[at] if e != "I" else (None, "", "")
            at += e != "I"
            if e == "K":
                lines.append(row[1] + ":" + row[2])
                state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
            elif e != "D":
                lines.append(("assistant" if state == 2 else "user") + ":" + row[2])
                state = NEXT[state]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(seq, seq[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(c // 4 == 2 for c in codes), sum(c // 4 == 4 for c in codes),
                    sum(c // 4 == 1 for c in codes), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_rows_equal_the_plain_version(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(150), None]:
        for turn in [*range(rng.randrange(1, 6)), *rng.choices([None, 0, 1, 9], k=rng.randrange(2))]:
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", "assistant", "system", None, "", "User", "tool"]),
                         rng.choice(["Hello.", "Hello", "Why? ", "same.", " \t\n", "", None, "é!\x0c", "x ", "a. b"])))
    df = spark.createDataFrame(rows, CONVS).withColumn("part", F.lit("z")).repartition(5)
    got = sorted(map(tuple, repair.repair(repair.damaged(df)).collect()), key=key)
    assert got == sorted(plain(rows), key=key)


def test_dropped_conversations_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVS)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.repair(repair.damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair.repair(repair.damaged(df.limit(0))).collect() == []
