"""Token ids of whole texts, and their pieces of bounded length."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: White space as SPLIT has it; Python's own \s has four control characters more.
BLANK = re.compile(r"[^\S\x1c-\x1f]+")
#: From about a million characters of one blank run on SPLIT overflows a stack; from this length on, runs are taken out of the text first.
LONG_BLANK = 100_000
#: The pattern that byte-level BPE vocabularies of this kind split texts with before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the box keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in such a vocabulary file: printable ones for
    themselves, the others as code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _ranks(path: str, marks: tuple[str, ...] = ()) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes to id, and special string to id; `marks` are special strings put after the file's own ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    free = max([*ranks.values(), *special.values()]) + 1
    return ranks, special | {m: free + i for i, m in enumerate(marks)}


@functools.cache
def byte_lengths(path: str, marks: tuple[str, ...] = ()) -> np.ndarray:
    """The number of bytes that each id stands for."""
    ranks, special = _ranks(path, marks)
    sizes = {i: len(b) for b, i in ranks.items()} | {i: len(s.encode()) for s, i in special.items()}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


@functools.cache
def encoder(path: str, more: tuple[str, ...] = ()):
    """text -> ids, as the `tokenizers` library gives them for a byte-level BPE file without
    special tokens being added; the merges run in `tiktoken`, which is four times as fast.

    Special strings (those of the file and `more`) that stand in a text become their ids, as that library has it by default.
    A blank run of any length is one piece of the split but for its last character, which
    belongs to what follows; long ones are cut out there and merged without SPLIT.
    """
    import tiktoken

    ranks, special = _ranks(path, more)
    made = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    unsplit = tiktoken.Encoding("unsplit", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def around_blanks(text: str) -> list[int]:
        ids: list[int] = []
        for part in marks.split(text) if marks else [text]:
            if part in special:
                ids.append(special[part])
                continue
            at = 0
            for m in BLANK.finditer(part):
                if m.end() - m.start() >= LONG_BLANK:
                    ids += made.encode_ordinary(part[at:m.start()])
                    at = m.end() - (m.end() < len(part))
                    ids += unsplit.encode_ordinary(part[m.start():at])
            ids += made.encode_ordinary(part[at:])
        return ids

    def encode(text: str) -> list[int]:
        # A run of twice this step, or longer, holds one of these slices.
        step = LONG_BLANK
        if any(text[i:i + step].isspace() for i in range(0, len(text) - step + 1, step)):
            return around_blanks(text)
        if any(s in text for s in special):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)

    return encode


def cut_places(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if it fits, else the first may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, path: str, length: int, end_id: int, key: str = "doc_id", text: str = "text",
           with_ids: bool = True, key_type: str = "long") -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) for every row of `docs`, whole texts.

    A document is its ids and then `end_id`; only one longer than `length` is cut. A null text
    counts as empty and gives one piece with `end_id` alone. `ids` holds little-endian unsigned
    32-bit numbers, of which `ids_crc32` is the checksum. Other columns are left out.
    """
    schema = f"key {key_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            # A few rows at a time: what is made of long texts is handed on before more is made.
            for at in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in range(4 + with_ids)]
                source, texts = [], batch.column(1).slice(at, 500).to_pylist()
                for i, t in enumerate(texts):
                    ids = np.array([*to_ids(t or ""), end_id], dtype="<u4")
                    for k, (start, n) in enumerate(cut_places(len(ids), length)):
                        own = ids[start:start + n].tobytes()
                        source.append(at + i)
                        for column, value in zip(out, (k, start, n, zlib.crc32(own), own)):
                            column.append(value)
                columns = [keys.take(pa.array(source, pa.int64()))]
                columns += [pa.array(v, kind) for v, kind in zip(out, kinds[1:])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS STRING) AS text").mapInArrow(encode, schema)
