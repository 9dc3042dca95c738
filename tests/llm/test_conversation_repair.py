"""Conversation repair against a search over all edits, row by row."""

import functools
import hashlib
import random
import sys
import re
import zlib

import pytest

from sievelake.llm import conversation_repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by trying every edit."""

    @functools.cache
    def rest(i, state, inserted=0):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        options = [(5, "I", NEXT[state], i, "", "")] if inserted < 3 else []
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", state, i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == NEXT[state] or role[:1] == "s" and state == "":
                    options.append((more, "K", role[:1], i + 1, role, text))
                options.append((more + 1, "R", NEXT[state], i + 1, None, text))
        for cost, letter, new, j, role, text in options:
            after = rest(j, new, inserted + 1 if letter == "I" else 0)
            if after is None:
                continue
            name = role if letter == "K" else NAMES.get(new)
            line = () if letter == "D" else (f"{name}:{text}",)
            found.append((cost + after[0], letter + after[1], line + after[2]))
        return min(found) if found else None

    sys.setrecursionlimit(20000)
    return rest(0, "")


def expected(rows):
    """`repaired` rows of (conv_id, turn, role, text)."""
    conversations = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    out = []
    for conv, own in conversations.items():
        own.sort()
        seen, faults = set(), []
        for *_, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        initials = [r[3][:1] for r in own]
        turns = {r[1] for r in own if r[0]}
        cost, audit, lines = cheapest(tuple((r[3], r[4], f) for r, f in zip(own, faults)))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, tie string").repartition(5)
    return sorted((tuple(r) for r in conversation_repair.repaired(table, **options).collect()), key=repr)


def made(seed, conversations=150, most=9):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", "ubiquitous", None]
    texts = ["Yes.", "No!", "Why?", "open", "", " \t", None, "end. \n", "a.b", "é!", "x\x0b"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None, 0]), rng.choice(roles), f"{rng.choice(texts) or ''}" if rng.random() < 0.8 else rng.choice(texts)))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk": 3}, {"chunk": 1}])
def test_same_repairs_as_a_search(spark, options):
    rows = made(4)
    assert found(spark, rows, **options) == expected(rows)


def test_one_long_conversation_and_no_rows(spark):
    rows = [(7, t, *random.Random(t).choice([("user", f"q{t % 40}?"), ("assistant", "a."), ("assistant", f"b{t}"), ("system", "s!")])) for t in range(250)]
    assert found(spark, rows, chunk=64) == expected(rows)
    assert found(spark, []) == []


def test_damage(spark):
    rows = [(c if c else None, t if t else None, "system", "One. Two! Three?") for c in range(20) for t in range(20)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, kind int")
    got = conversation_repair.damaged(table)
    assert got.columns == ["conv_id", "turn", "role", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    all_ = conversation_repair.of_all(conversation_repair.repaired(got), table.unionByName(spark.createDataFrame([(99, 0, "", "", 0)], table.schema)))
    last = all_.where("conv_id = 99").collect()
    assert [tuple(r) for r in last] == [(99, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] and all_.count() == 21
