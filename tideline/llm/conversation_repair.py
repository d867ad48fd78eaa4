"""Repair of a conversation's turns: the cheapest edits that make its roles alternate.

A repaired conversation's role initials are ``(s?(ua)+)?``. Its rows are kept, given another
role or deleted, and rows are inserted, each at a cost; among the cheapest edits the one whose
letters (the audit) come first in ASCII order is taken.

Both aims are one integer. An edit that is letter number p of the audit weighs

    cost * HISTORIES * 5**W  +  digit * 5**(W - 1 - p)

with W places for letters and the digits D 1, I 2, K 3, R 4; places after the last letter are
zero, so a shorter audit comes before the longer ones it begins. Edits are the arcs of a graph
whose nodes are (rows read, letters written, state of the pattern), and the path with the least
sum of integers decides cost, audit and ties at once.

A conversation of any length is read in segments. An insertion is written right before the
letter of a row, so of two audits of the same rows none begins the other, and the least one
per state stays the least whatever follows. Between segments each state holds its cost, its
place among the histories (the digit between cost and letters), a running digest and the
letters; neither texts nor growing integers are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm.common import map_arrow, query, table

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end with so far
HISTORIES = 4  # at most one per state
LETTERS = " DIKR"  # digits 1 to 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
SOUND, CUT_OFF, GONE = range(3)  # a row's fault as the search sees it: GONE must be deleted
SEGMENT_ROWS, SEGMENT_CHARS = 24, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
_NEXT = {EMPTY: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}


@lru_cache(maxsize=1 << 16)
def cheapest(symbols: tuple, entering: tuple, last: bool) -> dict[int, tuple[int, int, str]]:
    """For each state after the rows, its least path: (cost, index in ``entering``, letters).

    ``symbols``: (role initial, fault) of each row. ``entering``: (state, cost) of the
    histories that lead here, in the order of their letters. After the ``last`` rows one
    more insertion may follow. More than one insertion between two rows can't be cheapest:
    without two of them the roles still alternate, or a lone system row remains, whose
    deletion costs less than two insertions.
    """
    width = 2 * len(symbols) + 1
    unit = 5 ** width
    arc = lambda cost, letter, p: cost * HISTORIES * unit + LETTERS.index(letter) * 5 ** (width - 1 - p)
    nodes = {(0, state): (cost * HISTORIES + k) * unit for k, (state, cost) in enumerate(entering)}

    def reach(to: dict, p: int, state: int, value: int) -> None:
        if value < to.get((p, state), value + 1):
            to[p, state] = value

    def with_insertions(at: dict) -> dict:
        out = dict(at)
        for (p, state), value in at.items():
            reach(out, p + 1, _NEXT[state][0], value + arc(INSERT, "I", p))
        return out

    for initial, fault in symbols:
        after: dict = {}
        for (p, state), value in with_insertions(nodes).items():
            reach(after, p + 1, state, value + arc(DELETE, "D", p))
            if fault == GONE:
                continue
            more = TRUNCATED if fault == CUT_OFF else 0
            following, role = _NEXT[state]
            if initial == role[0]:
                reach(after, p + 1, following, value + arc(KEEP + more, "K", p))
            elif initial == "s" and state == EMPTY:
                reach(after, p + 1, SYSTEM, value + arc(KEEP + more, "K", p))
            reach(after, p + 1, following, value + arc(REROLE + more, "R", p))
        nodes = after
    if last:
        nodes = with_insertions(nodes)
    least: dict[int, int] = {}
    for (_, state), value in nodes.items():
        if value < least.get(state, value + 1):
            least[state] = value
    found = {}
    for state, value in least.items():
        head, low = divmod(value, unit)
        letters = []
        for _ in range(width):
            low, digit = divmod(low, 5)
            letters.append(LETTERS[digit])
        cost, entry = divmod(head, HISTORIES)
        found[state] = (cost, entry, "".join(reversed(letters)).rstrip())
    return found


class Repair:
    """One conversation, fed row by row in its order."""

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.before = None
        self.base = 0  # cost that all histories share
        # histories by the order of their letters: state, cost above the base, digest, (letters, earlier letters)
        self.histories = [(EMPTY, 0, hashlib.sha256(), None)]
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[tuple[str, int]] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.high:  # rows come by turn, missing ones first
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        body = text.rstrip(SPACE)
        fault = SOUND
        if not body:
            self.blank, fault = self.blank + 1, GONE
        elif seen:
            self.duplicate, fault = self.duplicate + 1, GONE
        elif body[-1] not in ".!?":
            self.truncated, fault = self.truncated + 1, CUT_OFF
        if len(self.rows) >= SEGMENT_ROWS or self.chars + len(text) > SEGMENT_CHARS and self.rows:
            self._segment()
        self.rows.append((role, text))
        self.symbols.append((initial if initial in ("s", "u", "a") else "", fault))
        self.chars += len(text)

    def _after(self, found: tuple[int, int, str]) -> tuple:
        """A history's digest and letters after the segment's rows."""
        _, entry, letters = found
        state, _, digest, earlier = self.histories[entry]
        digest = digest.copy()
        rows = iter(self.rows)
        first = state == EMPTY
        for letter in letters:
            role, text = ("", "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter != "K":
                role = _NEXT[state][1]
            state = SYSTEM if letter == "K" and role[:1] == "s" else _NEXT[state][0]
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        return digest, (letters, earlier)

    def _found(self, last: bool) -> dict[int, tuple[int, int, str]]:
        entering = tuple((state, cost) for state, cost, _, _ in self.histories)
        return cheapest(tuple(self.symbols), entering, last)

    def _segment(self) -> None:
        found = self._found(False)
        least = min(cost for cost, _, _ in found.values())
        ordered = sorted(found.items(), key=lambda x: x[1][1:])
        self.histories = [(state, way[0] - least, *self._after(way)) for state, way in ordered]
        self.base += least
        self.rows, self.symbols, self.chars = [], [], 0

    def result(self) -> dict:
        found = self._found(True)
        best = min((found[s] for s in (EMPTY, ASSISTANT) if s in found))
        digest, letters = self._after(best)
        parts = []
        while letters is not None:
            part, letters = letters
            parts.append(part)
        return {
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": self.base + best[0], "audit": "".join(reversed(parts)),
            "repaired_sha256": digest.hexdigest(),
        }


LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in LONGS) + ", audit string, repaired_sha256 string"
BATCH = 4096


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of rows that come sorted."""
    done: list[dict] = []
    current, now = None, None

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"conv_id": pa.int64()} | dict.fromkeys(LONGS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for conv, turn, role, text, seen, present in zip(*(part.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "seen", "present"))):
                if now is None or conv != current:
                    if now is not None:
                        done.append({"conv_id": current} | now.result())
                        if len(done) >= BATCH:
                            yield batch_of(done)
                            done = []
                    current, now = conv, Repair()
                if present:
                    now.add(turn, role, text, seen)
    if now is not None:
        done.append({"conv_id": current} | now.result())
    if done:
        yield batch_of(done)


def repair(conversations: DataFrame, present: str | None = None) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text, ...): its faults and its repair.

    Missing role or text counts as one space. Rows stand by turn (missing ones first), then role
    and text, so rows that tie need no other order; repeated rows are duplicates. A row's first
    fault counts: blank, duplicate (role and text seen earlier), truncated. Rows whose column
    ``present`` is false only name their conversation; one without rows has zeros and an empty
    audit. Missing conv_ids form one conversation. Other columns, whatever their names, are not
    looked at. An empty table gives an empty table.

    One shuffle by conversation. A conversation is one digest over all its text in order, so its
    rows go through one task, sorted and spilled by Spark; that task holds one segment of rows
    (1 MB, or one longer text) and the audit, however long the conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(f"`{present}`").cast("boolean"), F.lit(False)) if present else F.lit(True)).alias("present"),
    ).repartition("conv_id")
    what = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumn("what", F.when(F.col("present"), what))
    # the shuffle by conv_id serves this window, too: its keys contain conv_id
    same = Window.partitionBy("conv_id", "what").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("seen", F.row_number().over(same) > 1).drop("what")
    rows = rows.sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    return map_arrow(rows, _repaired, SCHEMA)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut off, repeated or given another role, by their key's checksum.

    Missing keys, roles and texts count as one space. Dropped rows stay with present = false.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate != 0).alias("present"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


#: crc32 of a text, bit by bit over its bytes; DuckDB has none.
_CRC = """
list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, octet_length(encode(key)) + 1), lambda i: ('0x' || substr(hex(encode(key)), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)))
"""

#: The search as a recursive query: one row per (conversation, rows read, state) with the least
#: cost and letters, as one text whose order is theirs.
SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), fated AS (
  SELECT *, xor({_CRC}, 4294967295::BIGINT) % 20 AS fate FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0
), placed AS (
  SELECT *, coalesce(conv_id, -1) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         left(role, 1) AS initial, rtrim(text, e' \\t\\n\\x0b\\x0c\\r') AS body
  FROM damaged
), met AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM met
), arcs(state, inserted, letter, following, price, initial) AS (
  -- one row each: an insertion or none, then the row's letter; E empty, s, u, a: what the repaired rows end with
  SELECT s.state, i.inserted, l.letter,
         CASE WHEN l.letter = 'D' THEN m.state WHEN l.letter = 'K' AND l.initial = 's' THEN 's'
              WHEN m.state = 'u' THEN 'a' ELSE 'u' END,
         l.price + 3 * length(i.inserted), l.initial
  FROM (VALUES ('E'), ('s'), ('u'), ('a')) s(state), (VALUES (''), ('I')) i(inserted),
       (VALUES ('D', 4, NULL), ('R', 3, NULL), ('K', 0, 's'), ('K', 0, 'u'), ('K', 0, 'a')) l(letter, price, initial),
       LATERAL (SELECT CASE WHEN i.inserted = '' THEN s.state WHEN s.state = 'u' THEN 'a' ELSE 'u' END AS state) m
  WHERE l.letter <> 'K' OR l.initial = 's' AND m.state = 'E' OR l.initial = 'a' AND m.state = 'u'
     OR l.initial = 'u' AND m.state <> 'u'
), search(conv, n, state, best) AS (
  SELECT DISTINCT conv, 0::BIGINT, 'E', '00000000' FROM faults
  UNION ALL
  SELECT s.conv, s.n + 1, a.following,
         min(lpad((left(s.best, 8)::INTEGER + a.price + CASE WHEN f.fault = 't' AND a.letter <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 8, '0')
             || substr(s.best, 9) || a.inserted || a.letter)
  FROM search s JOIN faults f ON f.conv = s.conv AND f.n = s.n + 1
       JOIN arcs a ON a.state = s.state AND (a.letter = 'D' OR f.fault NOT IN ('b', 'd'))
            AND (a.letter <> 'K' OR a.initial = f.initial)
  GROUP BY s.conv, s.n + 1, a.following
), ended AS (
  SELECT s.conv, min(CASE WHEN s.state IN ('E', 'a') THEN s.best
                          ELSE lpad((left(s.best, 8)::INTEGER + 3)::VARCHAR, 8, '0') || substr(s.best, 9) || 'I' END) AS best
  FROM search s JOIN (SELECT conv, max(n) AS n FROM faults GROUP BY conv) m ON m.conv = s.conv AND m.n = s.n
  WHERE s.state <> 's' GROUP BY s.conv
), letters AS (
  SELECT conv, p, substr(best, 8 + p, 1) AS letter,
         length(replace(substr(best, 9, p), 'I', '')) AS n,
         length(replace(substr(best, 9, p), 'D', '')) AS place
  FROM ended, LATERAL (SELECT unnest(range(1, length(best) - 7)) AS p)
), lines AS (
  SELECT l.conv, l.p, l.letter, l.place, f.role, f.text,
         max(CASE WHEN l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS system_first
  FROM letters l LEFT JOIN faults f ON f.conv = l.conv AND f.n = l.n AND l.letter <> 'I'
  WHERE l.letter <> 'D'
), repaired AS (
  SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system_first) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                 || ':' || coalesce(text, ''), e'\\n' ORDER BY p)) AS digest
  FROM lines GROUP BY conv
), counted AS (
  SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id, conv
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
       coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(left(e.best, 8)::BIGINT, 0) AS cost,
       coalesce(substr(e.best, 9), '') AS audit, coalesce(r.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv = coalesce(o.conv_id, -1) LEFT JOIN ended e ON e.conv = coalesce(o.conv_id, -1)
LEFT JOIN repaired r ON r.conv = coalesce(o.conv_id, -1)
"""


@query("op13_conversation_repair", SQL)
def op13_conversation_repair(spark, sf_dir):
    """Every conversation, damaged by the checksums of its turns: faults, cheapest repair and its digest."""
    return repair(damage(table(spark, sf_dir, "conversations")), present="present")
