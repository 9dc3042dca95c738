"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, as one text in which control strings mark every turn, and
encoded once with offsets. The spans of its assistant texts and the spans of its tokens are
both sorted, so a binary search tells for every token whether it falls inside one.

Turns are dealt to tasks by range, so a long conversation has many tasks, and read there as a
sorted stream. A conversation is handed on in several rows where a task ends, or where it is
longer than `CHUNK` characters, cut where a turn begins: the control string there is one token
of its own, so the ids are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.tokens import byte_lengths, encoder

START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
CHUNK = 1 << 20
#: Conversations (or chunks) encoded at a time.
TOGETHER = 128

#: Leading characters of a text by which turns that are equal otherwise are dealt.
HEAD = 64

MARKS = (START, MIDDLE, END)
FORMATTED = "conv_id long, chunk long, whole boolean, formatted string, ids binary, starts binary, ends binary, mask binary"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    """No control string is left in it; `plain` undoes it. One backslash is put into every `<|`,
    and one more into every `<`, backslashes, `|`."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def plain(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def rendered(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the sorted spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{MIDDLE}", escaped(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns = []
    for turn in text.split(START)[1:]:
        role, _, body = turn.partition(MIDDLE)
        turns.append((plain(role), plain(body.removesuffix(END))))
    return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For every token whether it shares a character with a span; both are sorted."""
    if not spans:
        return np.zeros(len(starts), np.uint8)
    first, last = np.array(spans, np.int64).T
    k = np.searchsorted(first, ends, side="left") - 1
    return ((k >= 0) & (ends > starts) & (last[np.maximum(k, 0)] > starts)).astype(np.uint8)


def with_offsets(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a rendered text, and where each begins and ends in code points.

    A token that holds a part of a character spans that character.
    """
    ids = np.array(encoder(vocabulary, MARKS)(text), np.int64)
    ends = np.cumsum(byte_lengths(vocabulary, MARKS)[ids])
    starts = ends - byte_lengths(vocabulary, MARKS)[ids]
    if not text.isascii():
        begun = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        starts, ends = begun[starts] - 1, begun[ends - 1]
    return ids, starts, ends


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def formatted(conversations: DataFrame, vocabulary: str, learn: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """`FORMATTED` rows of (conv_id, turn, role, text) rows, one per conversation and chunk.

    Turns go by `turn`, nulls first; of turns with the same number the role and then the text
    decide, and repeated rows are repeated turns. A null role or text counts as empty, a null
    conv_id is a conversation. `chunk` rises along a conversation, `whole` tells that the row is
    known to be all of it. `ids`, `starts` and `ends` hold little-endian unsigned 32-bit numbers (offsets
    in code points of the row's text), `mask` one byte per token: 1 in texts of the role `learn`.
    Other columns are left out; an empty table gives no row. Turns of one conversation that agree in
    number, role and the first `HEAD` characters are one task's.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ready = TaskContext.get().partitionId(), []

        def encoded() -> pa.RecordBatch:
            rows = []
            for conv, number, whole, text, spans in ready:
                ids, starts, ends = with_offsets(text, vocabulary)
                places = [v.astype("<u4").tobytes() for v in (ids, starts, ends)]
                rows.append((conv, number, whole, text, *places, masked(starts, ends, spans).tobytes()))
            ready.clear()
            return _batch(FORMATTED, rows)

        # The first and the last conversation may go on in the tasks before and after.
        now, first, number, turns, length = None, True, task << 32, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                role, text = role or "", text or ""
                if turns and (conv != now or length >= chunk):
                    whole = conv != now and not first and number == task << 32
                    ready.append((now, number, whole, *rendered(turns, learn)))
                    first = first and conv == now
                    number, turns, length = number + 1 if conv == now else task << 32, [], 0
                    if len(ready) >= TOGETHER or len(ready[-1][3]) >= chunk:
                        yield encoded()
                now = conv
                turns.append((role, text))
                length += len(role) + len(text)
        if turns:
            ready.append((now, number, False, *rendered(turns, learn)))
        if ready:
            yield encoded()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text"))
    # A fixed number of partitions: few small rows cost much work each, and the tasks number the chunks.
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, HEAD))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(render, FORMATTED)


def digested(rows: DataFrame) -> DataFrame:
    """What formatted rows hold, read back from them: one row per conversation.

    The loss text is put together from the offsets of the tokens under the mask. A whole
    conversation is digested where it is; the turns and loss texts of the others' chunks go on
    in order, as a digest is sequential. The rows may come in any order.
    """
    parts_schema = f"{DIGESTS}, chunk long, turns string, loss string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, said = r["formatted"], parsed(r["formatted"])
                turns = "".join(f"{role}\n{body}\n" for role, body in said)
                mask = np.frombuffer(r["mask"], np.uint8).astype(bool)
                starts, ends = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("starts", "ends"))
                edges = np.diff(np.r_[0, mask.astype(np.int8), 0])
                loss = "".join(plain(text[starts[a]:ends[b - 1]]) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)))
                hashes = [hashlib.sha256(v.encode()).hexdigest() if r["whole"] else None for v in (turns, loss)]
                kept = (None, None) if r["whole"] else (turns, loss)
                out.append((r["conv_id"], len(said), hashes[0], len(loss), hashes[1], len(text), r["chunk"], *kept))
            yield _batch(parts_schema, out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state and (r["conv_id"] != now or r["turns"] is None):
                    out.append(closed())
                    state = None
                if r["turns"] is None:
                    out.append(tuple(r[c.split()[0]] for c in DIGESTS.split(", ")))
                    continue
                now, state = r["conv_id"], state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for at, value in ((0, r["n_turns"]), (2, r["loss_chars"]), (4, r["formatted_chars"])):
                    state[at] += value
                state[1].update(r["turns"].encode())
                state[3].update(r["loss"].encode())
            yield _batch(DIGESTS, out)
        if state:
            yield _batch(DIGESTS, [closed()])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read_back = rows.mapInArrow(read, parts_schema).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "chunk")
    return read_back.mapInArrow(fold, DIGESTS)
