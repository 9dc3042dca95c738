"""Cheapest repair of damaged conversations.

A repaired conversation is empty, or has an optional system turn and then pairs of a user's and an
assistant's turn. Rows may be kept, given another role or deleted, and empty turns inserted. What
has been written so far is one of four states (nothing, system, user, assistant), so a repair is a
path over nodes (rows read, state), and the letters of its edits are its audit.

Rows are sorted by conversation and turn over all tasks, and cut into chunks of rows packed as one
byte each. The cost of the rest is found backwards; where a conversation has several chunks, each
gives a 4 x 4 table of costs from its first to its last states, and these are folded. Then the arcs
that lie on cheapest paths are ranked by the audits that begin with them, of 1, 2, 4, ... letters:
the rank for twice the length is that of the pair (own rank, rank of the arc behind the first half),
and the pointer to that arc is the pointer's pointer. The arc of the lowest rank leaves the start,
and every letter of the least audit is found through the pointers for the bits of its place.

Last the texts are read once, in order, next to the audits of their chunks, and digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import cut

#: Rows of a chunk, and nodes that are worked on at a time.
CHUNK, NODES = 1 << 14, 1 << 19
#: Costs of the edits.
RETURN, DROP, ADD, OPEN = 1, 2, 5, 5
FAR = 1 << 40
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user's or assistant's turn leads to.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ACCEPTED = np.array([0, FAR, FAR, 0], np.int64)
LETTERS = b"DIKR"
PAD = 255
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs of the rest by state, with turns inserted first if that is cheaper."""
    user, assistant = cost[:, USER].copy(), cost[:, ASSISTANT].copy()
    cost[:, USER] = np.minimum(user, ADD + assistant)
    cost[:, ASSISTANT] = np.minimum(assistant, ADD + user)
    cost[:, :USER] = np.minimum(cost[:, :USER], ADD + cost[:, USER:USER + 1])
    return cost


def _row_costs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of row codes: keep as system, as user, as assistant, and give the role user or assistant."""
    initial, fault = code & 3, code >> 2
    base = np.where(fault == TRUNCATED, OPEN, 0) + np.where((fault == BLANK) | (fault == DUPLICATE), FAR, 0)
    kept = [np.where(initial == k, base, FAR) for k in range(3)]
    return *kept, base + RETURN, base + RETURN


def rest_costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[place, sequence, state] costs of the rest, of `codes` [place, sequence]; PAD rows stand in front."""
    out = np.empty((len(codes) + 1, codes.shape[1], 4), np.int64)
    out[-1] = _closed(ends.astype(np.int64))
    for i in range(len(codes) - 1, -1, -1):
        after, code = out[i + 1], codes[i]
        system, user, assistant, to_user, to_assistant = _row_costs(code)
        now = after + DROP
        to_user, to_assistant = np.minimum(user, to_user) + after[:, USER], np.minimum(assistant, to_assistant) + after[:, ASSISTANT]
        for state in (NOTHING, SYSTEM, ASSISTANT):
            now[:, state] = np.minimum(now[:, state], to_user)
        now[:, USER] = np.minimum(now[:, USER], to_assistant)
        now[:, NOTHING] = np.minimum(now[:, NOTHING], system + after[:, SYSTEM])
        out[i] = np.minimum(np.where((code == PAD)[:, None], after, _closed(now)), FAR)
    return out


def cheapest_arcs(codes: np.ndarray, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(valid, target) of the arcs on cheapest paths: [place, sequence, state, letter], target as a node number.

    A chunk that is not the last of its conversation ends where its rows end.
    """
    n, s = codes.shape
    valid = np.zeros((n + 1, s, 4, 4), bool)
    node = np.arange((n + 1) * s * 4).reshape(n + 1, s, 4)
    target = np.zeros((n + 1, s, 4, 4), np.int64)
    real = (codes != PAD)[:, :, None]
    target[:-1, :, :, 0] = node[1:]
    valid[:-1, :, :, 0] = real & (cost[:-1] == cost[1:] + DROP)
    target[:, :, :, 1] = node[:, :, NEXT]
    valid[:, :, :, 1] = cost == cost[:, :, NEXT] + ADD
    valid[:-1, :, :, 1] &= real
    valid[-1, :, :, 1] &= last[:, None]
    if n:
        system, user, assistant, to_user, to_assistant = _row_costs(codes)
        change = np.stack([to_user, to_user, to_assistant, to_user], 2)
        keep = np.stack([user, user, assistant, user], 2)
        target[:-1, :, :, 2] = target[:-1, :, :, 3] = node[1:][:, :, NEXT]
        valid[:-1, :, :, 2] = real & (cost[:-1] == cost[1:][:, :, NEXT] + keep)
        valid[:-1, :, :, 3] = real & (cost[:-1] == cost[1:][:, :, NEXT] + change)
        begins = real[:, :, 0] & (cost[:-1, :, NOTHING] == cost[1:, :, SYSTEM] + system)
        target[:-1, :, NOTHING, 2] = np.where(begins, node[1:, :, SYSTEM], target[:-1, :, NOTHING, 2])
        valid[:-1, :, NOTHING, 2] |= begins
    return valid & (cost < FAR)[..., None], target


def least_audits(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray, entries: list[range]) -> list[tuple[list[int], list[bytes], list[int]]]:
    """For every sequence, and every state it may be entered in: costs, least audits and last states."""
    n, s = max(map(len, codes)), len(codes)
    padded = np.full((n, s), PAD, np.uint8)
    for k, code in enumerate(codes):
        padded[n - len(code):, k] = code
    cost = rest_costs(padded, ends)
    valid, target = cheapest_arcs(padded, cost, last)
    # Arcs are the nodes of the ranking; the end is one more, behind all that have no next arc.
    arc_node, letter = np.divmod(np.flatnonzero(valid), 4)
    end = len(letter)
    first = np.full(valid.size // 4 + 1, end)
    first[arc_node[::-1]] = np.arange(end)[::-1]  # the arc with the least letter
    to = target.reshape(-1, 4)[arc_node, letter]
    pointer = np.append(first[to], end)
    rank, steps, doubled = np.append(letter + 1, 0), np.append(np.ones(end, np.int64), 0), [pointer]
    while (pointer != end).any():
        steps = steps + steps[pointer]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
        doubled.append(pointer)
    # Of the arcs that leave a node, the one with the lowest rank.
    order = np.lexsort((rank[:-1], arc_node))
    lead = np.full(len(first), end)
    lead[arc_node[order][::-1]] = order[::-1]
    starts = [(k, state) for k, states in enumerate(entries) for state in states]
    at = np.array([lead[((n - len(codes[k])) * s + k) * 4 + state] for k, state in starts])
    length = steps[at]
    where = np.concatenate([[0], np.cumsum(length)])
    arc, place = np.repeat(at, length), np.arange(where[-1]) - np.repeat(where[:-1], length)
    for k, pointer in enumerate(doubled):
        arc = np.where(place >> k & 1 == 1, pointer[arc], arc)
    letters = np.frombuffer(LETTERS, np.uint8)[letter[arc]].tobytes() if len(arc) else b""
    out = [([], [], []) for _ in codes]
    for x, (k, state) in enumerate(starts):
        out[k][0].append(int(cost[n - len(codes[k]), k, state]))
        out[k][1].append(letters[where[x]:where[x + 1]])
        out[k][2].append(int(to[arc[where[x + 1] - 1]] % 4) if length[x] else state)
    return out


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of sequences of like length, not too many nodes together."""
    order, start = np.argsort(lengths, kind="stable"), 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k - start + 1) * 4 * (lengths[order[k]] + 1) > NODES:
            yield order[start:k]
            start = k


def _wrong(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether neighbours' initials (s, u, a, others as 0 to 3) may not follow each other."""
    return ~((after == 1) & ((before == 0) | (before == 2)) | (before == 1) & (after == 2))


CHUNKS = ("conv_id long, chunk long, turn long, tie string, row long, whole boolean, codes binary, blank long, duplicate long, "
          "truncated long, illegal long, first int, final int")
CHUNK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32()]


def _batch(columns: list[list], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in names.split(", ")])
    for c in columns:
        c.clear()
    return out


def _chunked(size: int):
    """Sorted rows (conv_id, turn, tie, row, code) as chunks; `whole` if it surely is all of its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        # `now`: the open chunk as the key of its first row, its codes, and whether its conversation began in this task.
        out, now, held = [[] for _ in CHUNK_TYPES], None, 0

        def close(ended: bool) -> None:
            nonlocal number
            key, codes, began = now
            code = np.concatenate(codes)
            initial, fault = code & 3, code >> 2
            row = (key[0], number, *key[1:], began and ended, code.tobytes(), *[int((fault == k).sum()) for k in (BLANK, DUPLICATE, TRUNCATED)],
                   int(_wrong(initial[:-1], initial[1:]).sum()), int(initial[0]), int(initial[-1]))
            for column, value in zip(out, row):
                column.append(value)
            number += 1

        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            ids, empty = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            codes = batch.column(4).to_numpy().astype(np.uint8)
            cuts = ((ids[1:] != ids[:-1]) | (empty[1:] != empty[:-1])).nonzero()[0] + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                one = None if empty[start] else int(ids[start])
                fresh = now is None or now[0][0] != one
                if fresh and now is not None:
                    close(True)
                    now = None
                while start < end:
                    if now is not None and held >= size:
                        close(False)
                        now, fresh = None, False
                    if now is None:
                        key = (one, *(batch.column(i)[start].as_py() for i in (1, 2, 3)))
                        now, held = (key, [], fresh and seen), 0
                    take = min(end - start, size - held)
                    now[1].append(codes[start:start + take])
                    held, start, seen = held + take, start + take, True
            if len(out[0]) >= 1000:
                yield _batch(out, CHUNK_TYPES, CHUNKS)
        if now is not None:
            close(False)  # the next task may go on with it
        if out[0]:
            yield _batch(out, CHUNK_TYPES, CHUNKS)

    return run


TABLES = "conv_id long, chunk long, costs array<long>"
ENDS = "chunk long, ends array<long>, last boolean"
AUDITS = "chunk long, costs array<long>, audits array<binary>, exits array<int>"
CHOSEN = "chunk long, state int, wrong long, begins boolean"


def _cost_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, chunk, codes) as costs from each state before the chunk to each state after it."""
    for batch in batches:
        out = [[], [], []]
        for conv, chunk, codes in zip(*(c.to_pylist() for c in batch.columns)):
            code = np.frombuffer(codes, np.uint8)
            cost = rest_costs(np.repeat(code[:, None], 4, 1), np.where(np.eye(4, dtype=bool), 0, FAR))
            for column, value in zip(out, (conv, chunk, cost[0].T.ravel().tolist())):
                column.append(value)
        yield _batch(out, [pa.int64(), pa.int64(), pa.list_(pa.int64())], TABLES)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`TABLES` sorted by conversation, last chunk first, as costs of the rest behind each chunk."""
    now, rest = (), None
    for batch in batches:
        out = [[], [], []]
        for conv, chunk, costs in zip(*(c.to_pylist() for c in batch.columns)):
            last = (conv,) != now
            if last:
                now, rest = (conv,), ACCEPTED
            for column, value in zip(out, (chunk, rest.tolist(), last)):
                column.append(value)
            rest = np.minimum((np.array(costs).reshape(4, 4) + rest[None, :]).min(axis=1), FAR)
        yield _batch(out, [pa.int64(), pa.list_(pa.int64()), pa.bool_()], ENDS)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, codes, whole, ends, last) as `AUDITS`; a whole conversation is entered in one state."""
    for batch in batches:
        chunk, codes, whole, ends, last = (c.to_pylist() for c in batch.columns)
        codes, ends = [np.frombuffer(c, np.uint8) for c in codes], np.array(ends, np.int64).reshape(-1, 4)
        for group in _groups(np.array([len(c) for c in codes], np.int64)):
            found = least_audits([codes[k] for k in group], ends[group], np.array([last[k] for k in group], bool),
                                 [range(1 if whole[k] else 4) for k in group])
            out = [[chunk[k] for k in group], *[[f[x] for f in found] for x in range(3)]]
            yield _batch(out, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32())], AUDITS)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, chunk, exits, first, final), sorted by conversation and chunk, as the state in which each is entered."""
    now, state, before = (), NOTHING, None
    for batch in batches:
        out = [[], [], [], []]
        for conv, chunk, exits, first, final in zip(*(c.to_pylist() for c in batch.columns)):
            new = (conv,) != now
            if new:
                now, state = (conv,), NOTHING
            wrong = 0 if new else int(_wrong(np.array([before]), np.array([first]))[0])
            for column, value in zip(out, (chunk, state, wrong, new)):
                column.append(value)
            state, before = exits[state], final
        yield _batch(out, [pa.int64(), pa.int32(), pa.int64(), pa.bool_()], CHOSEN)


REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")


class _Reading:
    """One conversation as its rows pass by."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.at, self.lines = conv, NOTHING, b"", 0, 0
        self.sums, self.audits, self.digest = [0] * 5, [], hashlib.sha256()
        self.low = self.high = None
        self.turns = 0

    def write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> None:
        """Turns that the audit inserts here."""
        while self.at < len(self.audit) and self.audit[self.at] == LETTERS[1]:
            self.write("assistant" if self.state == USER else "user", "")
            self.state, self.at = int(NEXT[self.state]), self.at + 1

    def chunk(self, audit: bytes, sums: list[int]) -> None:
        self.insert()
        self.audits.append(audit)
        self.audit, self.at, self.sums = audit, 0, [a + b for a, b in zip(self.sums, sums)]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        self.insert()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == LETTERS[0]:
            return
        if letter == LETTERS[3]:
            role = "assistant" if self.state == USER else "user"
        self.write(role, text)
        self.state = SYSTEM if role[:1] == "s" else int(NEXT[self.state])

    def result(self) -> tuple:
        self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.sums, b"".join(self.audits).decode(), self.digest.hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, role, text, audit, sums): the rows in order, before each chunk one row with its audit."""
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    out, one = [[] for _ in kinds], None
    for batch in batches:
        for conv, turn, role, text, audit, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if one is None or one.conv != conv:
                if one is not None:
                    for column, value in zip(out, one.result()):
                        column.append(value)
                one = _Reading(conv)
            if audit is not None:
                one.chunk(audit, sums)
            else:
                one.row(turn, role, text)
        if len(out[0]) >= 1000:
            yield _batch(out, kinds, REPAIRED)
    if one is not None:
        for column, value in zip(out, one.result()):
            column.append(value)
    if out[0]:
        yield _batch(out, kinds, REPAIRED)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`REPAIRED` rows of (conv_id, turn, role, text) rows, one per conversation.

    Rows go by turn, nulls first; rows of the same turn by the digest of role and text, so copies
    stand together. A null role or text counts as one space, a null conv_id is a conversation of its
    own. A row's fault is blank (nothing but white space), else duplicate (role and text of an
    earlier row), else truncated (no full stop, question or exclamation mark at the end). Keeping a
    row costs 0, another role 1, deleting it 2 and inserting a turn 5; a truncated row that stays
    costs 5 more, a blank or duplicate one must go. Of the cheapest repairs the one whose audit
    comes first is taken. Other columns are left out; an empty table gives no row.

    No step but the last holds more than a chunk of a conversation in a task; the last, a digest of
    all its text, reads a conversation as a stream in one.
    """
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = cut(rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("tie"),
        F.monotonically_increasing_id().alias("row")))
    order = ["conv_id", "turn", "tie", "row"]
    initial = F.expr("locate(substring(role, 1, 1), 'sua')")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    firsts = own.groupBy("conv_id", "tie").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "row"))["row"].alias("row")).select("row", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(0)
    letter = F.when((F.col("initial") > 0) & (F.col("named")), F.col("initial") - 1).otherwise(3)
    slim = own.select(*order, initial.alias("initial"), (F.col("role") != "").alias("named"), blank.alias("blank"), whole.alias("ended")).join(
        firsts, "row", "left").select(*order, (letter + 4 * fault).cast("int").alias("code"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_chunked(chunk), CHUNKS))

    # Chunks at the borders of tasks, or of conversations cut for their length, are folded.
    parted = chunks.where("NOT whole")
    tables = parted.select("conv_id", "chunk", "codes").repartition("chunk").mapInArrow(_cost_tables, TABLES)
    ends = tables.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_folded, ENDS)
    alone = chunks.where("whole").withColumns({"ends": F.array(*[F.lit(int(x)) for x in ACCEPTED]), "last": F.lit(True)})
    known = alone.unionByName(parted.join(ends, "chunk").select(*alone.columns))
    audits = cut(known.select("chunk", "codes", "whole", "ends", "last").mapInArrow(_audited, AUDITS))
    entered = parted.select("conv_id", "chunk", "first", "final").join(audits, "chunk").select("conv_id", "chunk", "exits", "first", "final")
    chosen = entered.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_entered, CHOSEN)
    state = F.coalesce(F.col("state"), F.lit(NOTHING)) + 1
    cost = F.when(F.coalesce("begins", F.lit(True)), F.element_at("costs", state)).otherwise(F.lit(0))
    sums = F.array("blank", "duplicate", "truncated", F.col("illegal") + F.coalesce("wrong", F.lit(0)), cost)
    heads = chunks.join(audits, "chunk").join(chosen, "chunk", "left").select(
        *order, F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), F.element_at("audits", state).alias("audit"), sums.alias("sums"))
    lines = own.select(*order, F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("binary").alias("audit"), F.lit(None).cast("array<long>").alias("sums"))
    read = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order, "kind")
    return read.select("conv_id", "turn", "role", "text", "audit", "sums").mapInArrow(_digested, REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults laid by crc32 of `conv_id:turn`, nulls as one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its full stops, question and
    exclamation marks away, 3 repeats it and 4 makes it a user's.
    """
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def of_all(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """`repaired` rows, and one of zeros for each conversation that has none of its rows left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = hashlib.sha256().hexdigest()
    rest = ids.join(found.select(F.col("conv_id").alias("other"), F.lit(True).alias("there")), F.col("conv_id").eqNullSafe(F.col("other")), "left")
    rest = rest.where("there IS NULL").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in found.columns[1:-2]],
                                              F.lit("").alias("audit"), F.lit(nothing).alias("repaired_sha256"))
    return found.unionByName(rest)
