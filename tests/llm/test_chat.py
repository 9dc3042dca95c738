"""Chat formatting as an exact round trip."""

import hashlib
import random

import numpy as np
import pytest

from sievelake.llm import chat, tokens

TEXTS = [None, "", "hi", "<|turn|>", "<\\|done|>", "<\\\\|x", "<<|says|>|", "a<", "|turn|>", "\\", "é😀\n\n ok ", "</s>[INST] ok [/INST]", " x ", "<|endoftext|>", "\u00a0 \u2003"]
ROLES = ["user", "assistant", "system", None, "assistant", "<|turn|>assistant", "as\nsistant"]


def conversations(seed=1):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS)) for c in range(60) for t in range(rng.randint(1, 9))]
    return rows + [(None, 1, "assistant", "no id"), (70, None, "user", "first"), (70, 1, "assistant", "x" * 5000), (80, 1, "assistant", "same"), (80, 1, "assistant", "same")]


def expected(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or "" if k > 1 else x or 0) for k, x in enumerate(r))):
        out.setdefault(c, []).append((role or "", text or ""))
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), hexed("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"),
                hexed("".join(b for a, b in t if a == "assistant"))) for c, t in out.items()}


@pytest.mark.parametrize("chunk", [1 << 20, 30])
def test_round_trip(spark, chunk):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, chunk int").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digested(chat.formatted(frame, tokens.vocabulary(), chunk=chunk)).collect()}
    assert got == expected(rows)


def test_chunks_have_the_ids_of_the_whole(spark):
    rows = spark.createDataFrame(conversations(3), "conv_id long, turn long, role string, text string").where("conv_id < 20")
    joined = {}
    for size in (1 << 20, 25):
        for r in sorted(chat.formatted(rows, tokens.vocabulary(), chunk=size).collect(), key=lambda r: (r["conv_id"], r["chunk"])):
            text, ids, mask = joined.setdefault(size, {}).setdefault(r["conv_id"], ["", [], []])
            joined[size][r["conv_id"]] = [text + r["formatted"], ids + np.frombuffer(r["ids"], "<u4").tolist(), mask + list(r["mask"])]
    assert joined[1 << 20] == joined[25]


@pytest.mark.parametrize("text", [t or "" for t in TEXTS] + ["a👩‍🚀b ́é中文", " \n\n  x\t"])
def test_ids_and_offsets_equal_the_library(text):
    from tokenizers import Tokenizer, processors

    library = Tokenizer.from_file(tokens.vocabulary())
    library.add_special_tokens(list(chat.MARKS))
    library.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep white space
    whole, _ = chat.rendered([("user", text), ("assistant", text + " " + text), ("assistant", "")])
    want = library.encode(whole, add_special_tokens=False)
    ids, starts, ends = chat.with_offsets(whole, tokens.vocabulary())
    assert ids.tolist() == want.ids
    assert list(zip(starts.tolist(), ends.tolist())) == want.offsets


def test_hot_conversation_has_many_tasks(spark):
    """A third of all turns in one conversation: without numbers (ties by role and text), and over a chunk long."""
    rng = random.Random(5)
    rows = [(7, None if i % 2 else i, rng.choice(ROLES), f"{rng.random()} {rng.choice(TEXTS)}" * 20) for i in range(3000)]
    rows += [(100 + i // 4, i % 4, "assistant", f"turn {i}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chat.formatted(frame, tokens.vocabulary(), chunk=20_000)
    sizes = {r["task"]: r["n"] for r in made.selectExpr("shiftright(chunk, 32) AS task", "length(formatted) AS n", "conv_id").where("conv_id = 7")
             .groupBy("task").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert len(sizes) >= 3 and max(sizes.values()) < sum(sizes.values()) / 2
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digested(made).collect()}
    assert got == expected(rows)
    # In any order, as from a table that was written.
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digested(made.repartition(3)).collect()} == got


def test_mask_by_every_token():
    spans, starts, ends = [(2, 5), (9, 10)], np.array([0, 2, 4, 5, 9, 9, 10]), np.array([2, 4, 5, 9, 9, 10, 12])
    want = [any(a < e and s < b and s < e for a, b in spans) for s, e in zip(starts, ends)]
    assert chat.masked(starts, ends, spans).astype(bool).tolist() == want
    assert not chat.masked(starts, ends, []).any()


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_escaping(text):
    assert chat.plain(chat.escaped(text)) == text
    assert not any(c in chat.escaped(text) for c in (chat.START, chat.MIDDLE, chat.END))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digested(chat.formatted(empty, tokens.vocabulary())).collect() == []
