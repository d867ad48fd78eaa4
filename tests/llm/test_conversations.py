"""Conversation repair: against all edits, in segments, and the awkward rows."""

import hashlib
import itertools
import random
import re

import pytest

from tideline.llm import conversation_repair as repair_of
from tideline.llm.conversation_repair import Repair, damage, repair

CONVERSATIONS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def all_edits(rows, inserts):
    """(cost, audit, repaired rows) of every way to edit (role, text, fault) rows with up to ``inserts`` in a row."""
    for slots in itertools.product(*[[c for n in range(inserts + 1) for c in itertools.product(("user", "assistant"), repeat=n)]
                                     for _ in range(len(rows) + 1)]):
        for letters in itertools.product("DKua", repeat=len(rows)):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for role in slots[k]:
                    cost, audit = cost + 3, audit + "I"
                    out.append((role, ""))
                if k == len(rows):
                    continue
                role, text, fault = rows[k]
                if letters[k] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if fault == 2:
                    break
                cost += 3 * (fault == 1)
                if letters[k] == "K":
                    audit += "K"
                    out.append((role, text))
                else:
                    cost, audit = cost + 3, audit + "R"
                    out.append(({"u": "user", "a": "assistant"}[letters[k]], text))
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    yield cost, audit, out


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def fed(rows):
    """The result over (role, text, fault) rows."""
    done = Repair()
    for n, (role, text, fault) in enumerate(rows):
        done.add(n, role, text, fault == 2)
    return done.result()


def random_rows(r, n):
    """Rows with faults 0 (none), 1 (cut off), 2 (seen before)."""
    out = []
    for k in range(n):
        fault = r.choice([0, 0, 0, 1, 2])
        out.append((r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ugly"]), f"t{k}" + "." * (fault != 1), fault))
    return out


@pytest.mark.parametrize("n, inserts, tries", [(0, 2, 1), (1, 2, 30), (2, 2, 40), (3, 1, 60), (4, 1, 12)])
def test_cheapest_edits_against_all_edits(n, inserts, tries):
    r = random.Random(n)
    for _ in range(tries):
        rows = random_rows(r, n)
        cost, audit, out = min(all_edits(rows, inserts), key=lambda x: x[:2])
        got = fed(rows)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, digest(out)), rows


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_change_nothing(monkeypatch, size):
    r = random.Random(size)
    cases = [random_rows(r, r.randint(0, 20)) for _ in range(150)]
    whole = [fed(c) for c in cases]
    monkeypatch.setattr(repair_of, "SEGMENT_ROWS", size)
    assert [fed(c) for c in cases] == whole
    monkeypatch.setattr(repair_of, "SEGMENT_CHARS", 3)
    assert [fed(c) for c in cases] == whole


def test_one_conversation_of_very_many_rows():
    got = fed([("assistant", f"{k}.", 0) for k in range(30_001)])
    assert got["cost"] == 3 * 15_001 and len(got["audit"]) == 30_002 and got["illegal"] == 30_000


def test_awkward_conversations(spark):
    long_text = "word " * 700_000 + "end"  # above a segment's characters
    rows = [
        (1, 0, "system", "Be.", 9, "x"), (1, 1, "user", "Hello?", 9, "x"), (1, 2, "assistant", "Yes.", 9, "x"),
        (2, None, None, None, 9, "x"), (2, None, "user", "A.", 9, "x"), (2, 5, "user", "A.", 9, "x"), (2, 8, "assistant", "B", 9, None),
        (3, 0, "user", "Same.", 9, "x"), (3, 0, "user", "Same.", 9, "x"), (3, 1, "assistant", "Ok.", 9, "x"),
        (None, None, "assistant", " \t\n\x0b\x0c\r", 9, "x"), (None, None, "", "", 9, "x"),
        (4, 0, "user", long_text, 9, "x"), (4, 1, "assistant", "é漢🦑!", 9, "x"), (4, 2, "user", "Q?", 9, "x"),
    ]
    clash = CONVERSATIONS + ", seen long, present string"
    got = {r.conv_id: r.asDict() for r in repair(spark.createDataFrame(rows, clash)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    faults = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    assert [got[1][c] for c in faults] == [0, 0, 0, 0, 0, 0, "KKK"]
    # turn null: role and text of one space (blank), then user; user again (seen); a cut-off answer
    assert [got[2][c] for c in faults] == [2, 1, 1, 1, 2, 11, "DKDK"]
    assert got[2]["repaired_sha256"] == digest([("user", "A."), ("assistant", "B")])
    assert [got[3][c] for c in faults] == [0, 0, 1, 0, 1, 4, "KDK"]
    assert [got[None][c] for c in faults] == [0, 2, 0, 0, 1, 8, "DD"]
    assert got[None]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    # cut off: deleting both user turns and the answer would cost 12
    assert [got[4][c] for c in faults] == [0, 0, 0, 1, 0, 6, "KKKI"]
    assert got[4]["repaired_sha256"] == digest([("user", long_text), ("assistant", "é漢🦑!"), ("user", "Q?"), ("assistant", "")])
    assert repair(spark.createDataFrame(rows, clash).limit(0)).count() == 0


def test_rows_that_only_name_their_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.", False), (1, 1, "assistant", "B.", None), (2, 0, "user", "A.", True)],
                                 CONVERSATIONS + ", here boolean")
    got = {r.conv_id: (r.cost, r.audit, r.gaps, r.repaired_sha256) for r in repair(rows, "here").collect()}
    assert got == {1: (0, "", 0, hashlib.sha256(b"").hexdigest()), 2: (3, "KI", 0, digest([("user", "A."), ("assistant", "")]))}


def test_damage(spark):
    import zlib

    rows = [(c, t, ("system", "user", None)[(t or 0) % 3], None if t == 4 else f"One. Two? {c}!")
            for c in [*range(30), None] for t in [*range(8), None]]
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want += [(c, t, "user" if fate == 4 else role, text, fate != 0)] * (2 if fate == 3 else 1)
    got = [tuple(r) for r in damage(spark.createDataFrame(rows, CONVERSATIONS)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[4] for r in got}) == 2
