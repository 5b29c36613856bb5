"""Conversation repair against an enumeration of all edits, and its edge cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from logtide.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\v\f\r"


def plainly(rows):
    """What the operator returns for one conversation, by trying every edit of every row."""
    shown = lambda value: " " if value is None else str(value)
    hurt = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        hurt += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in hurt:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(at, last, inserts):
        """(cost, edits, repaired) of the rows from `at` on, after a turn with initial `last`."""
        found = []
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if at == len(hurt) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if role[0] in allowed:
                    cost, edits, turns = best(at, role[0], inserts + 1)
                    found.append((cost + 2, "I" + edits, ((role, ""), *turns)))
        if at < len(hurt):
            _, role, text = hurt[at]
            cost, edits, turns = best(at + 1, last, 0)
            found.append((cost + 3, "D" + edits, turns))
            if faults[at] in ("", "truncated"):
                for edit, price, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if new[:1] and new[0] in allowed:
                        cost, edits, turns = best(at + 1, new[0], 0)
                        found.append((cost + price + (faults[at] == "truncated"), edit + edits, ((new, text), *turns)))
        return min(found, default=(10**6, "", ()))

    cost, edits, turns = best(0, "", 0)
    known = [t for t, _, _ in hurt if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(hurt, hurt[1:])]
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()
    counts = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))
    return (*counts, cost, edits, digest)


def _conversations(number, longest, seed):
    draw = random.Random(seed)
    rows = []
    for conv_id in range(number):
        for turn in range(draw.randint(0, longest)):
            at = draw.choice([turn, turn, turn, turn + draw.randint(0, 3), None])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv_id if conv_id else None, at, role, draw.choice(["Yes.", "no", "  ", "", None, "What?\n", "ok!", "a. b", "é 🙂", "Yes."])))
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _compare(spark, rows, made):
    wanted = {conv_id: plainly([r for r in rows if r[0] == conv_id]) for conv_id in {r[0] for r in rows}}
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in made.collect()}
    assert found == wanted


@pytest.mark.parametrize("longest", [3, 9])
def test_equals_trying_all_edits(spark, longest):
    rows = _conversations(150, longest, longest)
    frame = spark.createDataFrame(rows, ROWS).withColumns({"later": F.lit(3), "kind": F.lit("x"), "mark": F.lit(1), "present": F.lit(0)})
    _compare(spark, rows, repair.judged(frame))


def test_backpointers_that_left_the_task(spark):
    rows = _conversations(40, 30, 7)
    hurt = repair.damaged(spark.createDataFrame(rows, ROWS))
    whole, split = (sorted(map(tuple, repair.edits(hurt, chunk).collect()), key=repr) for chunk in (1 << 16, 4))
    assert whole == split and any(len(r[-1]) > 12 for r in whole)


def test_turns_that_stay(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Fine."), (2, 5, "system", "Be kind.")]
    hurt = spark.createDataFrame(rows, ROWS).withColumn("present", F.lit(True))
    edited = repair.edits(hurt)
    turns = [tuple(r) for r in repair.repaired(hurt, edited).orderBy("conv_id", "position").collect()]
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in edited.collect()} == {1: ("RK", 2), 2: ("D", 3)}
    assert turns == [(1, 0, "R", "user", "Hello."), (1, 1, "K", "assistant", "Fine.")]


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(9, turn, ("user", "assistant")[turn % 2], f"Turn {turn}.") for turn in range(3_000)] + [(8, 1, "user", "x" * 2_000_000 + ".")]
    made = {r["conv_id"]: r for r in repair.judged(spark.createDataFrame(rows, ROWS)).collect()}
    assert len(made[9]["audit"].replace("I", "")) + 0 == sum(
        {0: 0, 3: 2}.get(zlib.crc32(f"9:{turn}".encode()) % 20, 1) for turn in range(3_000)
    )
    assert tuple(made[8][c] for c in COLUMNS) == plainly([r for r in rows if r[0] == 8])


def test_no_rows(spark):
    assert repair.judged(spark.createDataFrame([], ROWS)).count() == 0
