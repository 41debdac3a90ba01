"""Operator 8, token-id output: best-fit-decreasing packing.

Documents are encoded with a byte-level BPE of given ranks, each ended by the
token ``end``, and cut into pieces of at most ``length`` tokens without loss. The
pieces of a pool of about ``pool_tokens`` tokens, documents that lie one after the
other in the input, are packed by best fit decreasing: the longest piece first,
into the row whose free space is least but enough. A segment tree over
capacities finds that row in O(log length).

A row of the result is one row of the packed id matrix. ``decode`` reads it back.

Defined results
  * Every token of every document is in exactly one row; ``doc_ids``,
    ``doc_offsets`` (first token of the piece in its document) and ``doc_rows`` (a
    number of the input row within the pool) put documents together again.
  * Ties: of pieces of one length the earlier one is packed first, and of rows with
    equal space the one that got it last is taken; so a pool's rows depend on the
    order of its documents alone.
  * Null and empty texts are the end token alone. Repeated rows are packed
    each. Null ids are null in doc_ids. Special tokens' strings in a text are
    ordinary text. Only id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

#: The published pre-token pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Settings:
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    length: int = 2048
    end: int = 50256
    pad: int = 50256
    pool_tokens: int = 4 << 20


@lru_cache(maxsize=2)
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class CapacityTree:
    """A multiset of capacities 0..top: the least one that is at least n, in O(log top)."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int = 1) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, n: int) -> int:
        """-1 if there is none."""
        count, i = self.count, self.leaves + n
        if count[i]:
            return n
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces of each row. Among pieces of one size the earlier comes first."""
    rows: list[list[int]] = []
    free: dict[int, list[int]] = {}
    tree = CapacityTree(length)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        c = tree.least(n) if n < length else -1
        if c < 0:
            c, row = length, len(rows)
            rows.append([])
        else:
            row = free[c].pop()
            tree.add(c, -1)
        rows[row].append(i)
        if c > n:
            free.setdefault(c - n, []).append(row)
            tree.add(c - n)
    return rows


SCHEMA = "pool string, row int, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{}>, doc_offsets array<int>, doc_rows array<int>"


def _pack(s: Settings, width: np.dtype, pool: str, ids: list[pa.Array], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys = pa.concat_arrays(ids)
    total = np.array([len(t) for t in tokens])
    pieces = -(-total // s.length)
    doc = np.repeat(np.arange(len(tokens)), pieces)
    offset = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * s.length
    sizes = np.minimum(total[doc] - offset, s.length)
    flat = np.concatenate(tokens)
    begin = (np.cumsum(total) - total)[doc] + offset
    rows = best_fit_decreasing(sizes, s.length)
    steps = np.arange(s.length, dtype=width)
    for a in range(0, len(rows), 512):
        part = rows[a : a + 512]
        n = len(part)
        matrix = np.full((n, s.length), s.pad, dtype=width)
        places = np.zeros((n, s.length), dtype=width)
        ends = []
        for r, own in enumerate(part):
            at, cu = 0, [0]
            for i in own:
                k = int(sizes[i])
                matrix[r, at : at + k] = flat[begin[i] : begin[i] + k]
                places[r, at : at + k] = steps[:k]
                at += k
                cu.append(at)
            ends.append(cu)
        order = np.concatenate([np.array(own) for own in part])
        lists = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in part])]), pa.int32())
        blob = lambda m: pa.Array.from_buffers(pa.binary(m.itemsize * s.length), n, [None, pa.py_buffer(m)]).cast(pa.binary())
        of = lambda values: pa.ListArray.from_arrays(lists, values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([pool] * n),
                pa.array(np.arange(a, a + n), pa.int32()),
                pa.array([cu[-1] for cu in ends], pa.int32()),
                blob(matrix),
                blob(places),
                pa.array(ends, pa.list_(pa.int32())),
                of(keys.take(pa.array(doc[order]))),
                of(pa.array(offset[order], pa.int32())),
                of(pa.array(doc[order], pa.int32())),
            ],
            ["pool", "row", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets", "doc_rows"],
        )


def token_type(s: Settings) -> np.dtype:
    """Little-endian unsigned integers of 2 bytes where ids and places fit, else of 4."""
    return np.dtype("<u2" if max(encoding(s.ranks).n_vocab, s.end, s.pad, s.length) < 1 << 16 else "<u4")


def packed(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoding(s.ranks).encode_ordinary, token_type(s)
        end = np.array([s.end], dtype=width)
        part, pool, held = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        for batch in K.byte_chunks(batches, 1):
            ids.append(batch.column(0))
            for t in batch.column(1):
                own = encode(t.as_py() or "")
                tokens.append(np.append(np.fromiter(own, width, len(own)), end))
                held += len(own) + 1
            if held >= s.pool_tokens:
                yield from _pack(s, width, f"{part}-{pool}", ids, tokens)
                ids, tokens, held, pool = [], [], 0, pool + 1
        if ids:
            yield from _pack(s, width, f"{part}-{pool}", ids, tokens)

    slim = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return slim.mapInArrow(run, SCHEMA.format(docs.schema[doc_id].dataType.simpleString()))


def decode(rows: list, s: Settings = Settings()) -> list[tuple]:
    """(doc_id, text) of all documents in rows of packed(), every pool complete."""
    width, enc = token_type(s), encoding(s.ranks)
    pieces: dict[tuple, list] = {}
    for r in rows:
        ids = np.frombuffer(r.ids, width)
        for a, b, key, offset, doc in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets, r.doc_rows):
            pieces.setdefault((r.pool, doc), []).append((offset, ids[a:b], key))
    out = []
    for own in pieces.values():
        own.sort(key=lambda x: x[0])
        tokens = np.concatenate([t for _, t, _ in own])
        assert tokens[-1] == s.end
        out.append((own[0][2], enc.decode(tokens[:-1].tolist())))
    return out
