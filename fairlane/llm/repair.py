"""Conversation structure repair by iterative-deepening A*.

A conversation's roles have to read ``(s?(ua)+)?`` by their initials. Its
rows may be kept (cost 0), given the role that comes next (1) or deleted (2),
and empty rows of the next role inserted anywhere (5); blank and duplicate
rows must be deleted, a truncated row that stays costs 5 more. The cheapest
edits are wanted, of equals those whose initials (D, I, K, R) are ASCII-least.

The search is depth-first in ASCII order under a cost bound. What a state (row,
role state) was found to need at least is kept in a table of failed states;
the bound rises to the least sum that broke it. The first accepting path under
the first sufficient bound is then cheapest and ASCII-least at once. The
estimate of the remaining cost is that of a relaxed grammar (leading system
rows may repeat), so it never exceeds the true one and mostly comes near it.

Scale: one shuffle by conversation. Every row is sent twice, first without
its text (place, role initial, digest, faults), then with it. A task reads
its sorted rows as a stream: from the first part it makes the edits, along
the second it hashes the repaired text. So the texts of a conversation are
never held together; a task keeps 17 bytes a row of the one conversation it
reads, and the table of its failed states.

Nulls count as one space, a null conversation id is one conversation. Rows of
one turn (or of none) have no order of their own: they are taken by role and
digest of the text, whatever the partitions. Empty texts are blank, copies of
a row are duplicates, and a conversation without rows after damage has zeros,
an empty audit and the hash of an empty text. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import prepare

SPACE = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# role initials and row codes: 0 s, 1 u, 2 a, 3 other; 4 truncated, 8 blank, 16 duplicate
CUT, BLANK, AGAIN = 4, 8, 16
# role states: 0 start, 1 after s, 2 after u, 3 after an answer
KEEPS = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
ROLES = ("user", "user", "assistant", "user")
LEGAL = {(0, 1), (1, 2), (2, 1)}
REMEMBERED = 1 << 16


def _estimates(codes: bytes) -> list[tuple[int, int, int]]:
    """Cost still needed at least before each row, by relaxed state: leading, after u, after an answer.

    Leading system rows may be kept, each for the cost of a new role; the start, which has one free, needs 1 less.
    """
    out = [(0, INSERT, 0)]
    for code in reversed(codes):
        lead, asked, answered = out[-1]
        now = [lead + DELETE, asked + DELETE, answered + DELETE]
        if code < BLANK:
            stay, role = TRUNCATED * (code >= CUT), code % CUT
            now[0] = min(now[0], stay + (asked if role == 1 else REROLE + min(lead, asked) if role == 0 else REROLE + asked))
            now[1] = min(now[1], stay + (answered if role == 2 else answered + REROLE))
            now[2] = min(now[2], stay + (asked if role == 1 else asked + REROLE))
        asked, answered = min(now[1], now[2] + INSERT), min(now[2], now[1] + INSERT)
        out.append((min(now[0], asked + INSERT), asked, answered))
    return out[::-1]


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, initials) of the cheapest, ASCII-least edits of a conversation's row codes."""
    rest, end = _estimates(codes), len(codes)
    failed: dict[tuple[int, int], int] = {}          # state -> cost it needs at least

    def need(at: int, state: int) -> int:
        return failed[at, state] if (at, state) in failed else rest[at][state - 1] if state else max(0, rest[at][0] - REROLE)

    def edits(at: int, state: int):
        """(initial, cost, next row, next state) in ASCII order."""
        if at < end:
            yield "D", DELETE, at + 1, state
        yield "I", INSERT, at, NEXT[state]
        if at < end and codes[at] < BLANK:
            stay, kept = TRUNCATED * (codes[at] >= CUT), KEEPS[state][codes[at] % CUT]
            if kept is not None:
                yield "K", stay, at + 1, kept
            yield "R", stay + REROLE, at + 1, NEXT[state]

    bound = need(0, 0)
    while True:
        # frames: row, state, cost left, its edits, least need beyond the cost left
        path, frames = [], [[0, 0, bound, edits(0, 0), None]]
        while frames:
            frame = frames[-1]
            at, state, left, ways, least = frame
            if at == end and state in ENDS:
                return bound - left, "".join(path)
            for initial, cost, to, then in ways:
                wanted = cost + need(to, then)
                if wanted <= left:
                    path.append(initial)
                    frames.append([to, then, left - cost, edits(to, then), None])
                    break
                if least is None or wanted < least:
                    frame[4] = least = wanted
            else:
                frames.pop()
                failed[at, state] = least
                if frames:
                    path.pop()
                    # the failed state's parent needs at least what it costs to get there and on
                    up = frames[-1]
                    beyond = up[2] - left + least
                    if up[4] is None or beyond < up[4]:
                        up[4] = beyond
        bound = failed[0, 0]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the crc32 of ``conv_id:turn``, as the contract says.

    ``copies`` is 0 for a dropped row and 2 for a repeated one.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), dice.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("copies"))


OUT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
       ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


class _Conversation:
    """What a task knows of the conversation whose rows it is reading."""

    def __init__(self, known: dict):
        self.known = known                              # edits of row codes seen before in this task
        self.codes, self.digests = bytearray(), bytearray()
        self.low = self.high = None
        self.turns = 0
        self.cost, self.audit = None, ""

    def first(self, turn, code: int, copies: int, digest: bytes) -> None:
        """A row of the first part."""
        if not copies:
            return
        self.codes += bytes([code]) * copies
        self.digests += digest * copies
        if turn is not None and turn != self.high:      # turns come in order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def plan(self) -> None:
        """Mark duplicates and find the edits."""
        codes = np.frombuffer(bytes(self.codes), np.uint8).copy()
        _, firsts = np.unique(np.frombuffer(bytes(self.digests), "V16"), return_index=True) if len(codes) else (None, [])
        again = np.ones(len(codes), bool)
        again[firsts] = False
        blank = codes & BLANK > 0
        codes[again & ~blank] |= AGAIN
        fault = codes >= BLANK
        self.counts = [0 if self.low is None else self.high - self.low + 1 - self.turns, int(blank.sum()), int((again & ~blank).sum()),
                       int(((codes & CUT > 0) & ~fault).sum())]
        role = codes & 3
        pairs = np.bincount(role[:-1] * 4 + role[1:], minlength=16)
        self.counts.append(int(pairs.sum() - sum(pairs[a * 4 + b] for a, b in LEGAL)))
        codes = codes.tobytes()
        edits = self.known.get(codes)
        if edits is None:
            edits = cheapest_edits(codes)
            if len(codes) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[codes] = edits
        self.cost, self.audit = edits
        self.codes = self.digests = b""
        self.at = self.state = 0
        self.lines, self.hash = 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.line(ROLES[self.state], "")
            self.state = NEXT[self.state]
            self.at += 1

    def second(self, role: str, code: int, copies: int, text: str) -> None:
        """A row of the second part: apply its edits."""
        for _ in range(copies):
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.line(role, text)
                self.state = KEEPS[self.state][code % CUT]
            elif edit == "R":
                self.line(ROLES[self.state], text)
                self.state = NEXT[self.state]

    def result(self) -> list:
        if self.cost is None:
            self.plan()
        self.inserts()
        return [*self.counts, self.cost, self.audit, self.hash.hexdigest()]


def repair(rows: DataFrame) -> DataFrame:
    """The audit of every conversation of rows (conv_id, turn, role, text, copies).

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256). ``gaps`` are the turns missing between the first and the
    last. A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated. ``illegal`` are neighbours not su, ua or au.
    """
    prepare(rows.sparkSession)
    ended = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + F.when(ended == "", BLANK).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    coded = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies"),
                        code.cast("int").alias("code"), digest.alias("digest"))
    part = F.explode(F.when(F.col("copies") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    sent = coded.select("*", part.alias("part")).withColumn("text", F.when(F.col("part") == 1, F.col("text")))
    sent = sent.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    id_field = rows.select("conv_id").schema[0]

    def run(batches):
        known: dict = {}
        conv, now, ids, out, id_type = None, None, [], [], pa.int64()

        def done():
            cols = [pa.array(ids, id_type), *(pa.array(c, t) for c, (_, t) in zip(zip(*out), OUT))]
            batch = pa.RecordBatch.from_arrays(cols, ["conv_id", *(n for n, _ in OUT)])
            ids.clear()
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.column("conv_id").type
            cols = (batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "code", "copies", "digest", "text"))
            for c, p, turn, role, code, copies, digest, text in zip(*cols):
                if now is None or c != conv:
                    if now is not None:
                        ids.append(conv)
                        out.append(now.result())
                    conv, now = c, _Conversation(known)
                if p == 0:
                    now.first(turn, code, copies, digest)
                else:
                    if now.cost is None:
                        now.plan()
                    now.second(role, code, copies, text)
            if len(out) >= 4096:
                yield done()
        if now is not None:
            ids.append(conv)
            out.append(now.result())
            yield done()

    schema = (f"conv_id {id_field.dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string, repaired_sha256 string")
    return sent.mapInArrow(run, schema)


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS b
  FROM conversations),
diced AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM diced WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS p,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before,
         CASE WHEN ended = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
inserts(s, t, c, a, o) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:')),
ids AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT conv_id, 0 AS p, t AS s, struct_pack(c := c, a := a, o := o) AS b FROM ids, inserts WHERE s = 0
  UNION ALL
  SELECT g.conv_id, g.p, i.t, min(struct_pack(c := g.c + i.c, a := g.a || i.a, o := g.o || i.o)) FROM (
    SELECT e.conv_id, f.p, m.c + e.b.c AS c, e.b.a || m.e AS a,
           e.b.o || CASE m.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
                    ELSE chr(10) || CASE e.s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || f.text END AS o,
           CASE WHEN m.e = 'D' THEN e.s WHEN m.e = 'K' AND f.i = 's' THEN 1 WHEN e.s = 2 THEN 3 ELSE 2 END AS t
    FROM best e JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.p = e.p + 1
    JOIN (SELECT p, conv_id, unnest(['D', 'K', 'R']) AS e, unnest([2, 0, 1]) + CASE WHEN fault = 'truncated' THEN unnest([0, 5, 5]) ELSE 0 END AS c
          FROM faults) m ON m.p = f.p AND m.conv_id IS NOT DISTINCT FROM f.conv_id
    WHERE m.e = 'D' OR f.fault IN ('', 'truncated') AND (m.e = 'R' OR f.i = CASE e.s WHEN 2 THEN 'a' ELSE 'u' END OR f.i = 's' AND e.s = 0)) g
  JOIN inserts i ON i.s = g.t
  GROUP BY g.conv_id, g.p, i.t),
ends AS (
  SELECT b.conv_id, min(b.b) AS b FROM best b LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
  WHERE b.p = coalesce(n.n, 0) AND b.s IN (0, 3) GROUP BY b.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, e.b.c::BIGINT AS cost, e.b.a AS audit, sha256(substr(e.b.o, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
