"""Vectorised text kernel shared by the operators of this subpackage.

Everything here works on whole Arrow string arrays: the UTF-8 buffer is read in
place with numpy, so no Python object is made per word. A *word* is a maximal
run of lower-cased ASCII letters, digits and non-ASCII characters; everything
else separates words. Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is hashed whole, alone.
CHUNK_BYTES = 1 << 20

WORD_PATTERN = r"[a-z0-9\x80-\U0010ffff]+"

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES)
        table = np.empty(size, dtype=np.uint64)
        table[0] = 1
        done = 1
        while done < size:  # doubling: the next block is the known one times base**done
            step = min(done, size - done)
            table[done : done + step] = table[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size > CHUNK_BYTES:
            return table  # tables for very long texts aren't kept
        _powers[base] = table
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """hashes: one per word. bounds: words of text d are bounds[d]:bounds[d+1].
    starts, ends: byte places of each word in data, the lower-cased bytes."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def text(self, i: int, j: int) -> list[str]:
        return [self.data[self.starts[k] : self.ends[k]].tobytes().decode() for k in range(i, j)]


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a large_string array without nulls."""
    n = len(array)
    _, offsets, data = array.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array | pa.ChunkedArray) -> Words:
    """Bytes that are no UTF-8 become U+FFFD."""
    array = string_array(column)
    try:
        lower = pc.utf8_lower(array)
    except pa.ArrowInvalid:
        raw = array.cast(pa.large_binary()).to_pylist()
        lower = pc.utf8_lower(pa.array([x.decode("utf-8", "replace") for x in raw], pa.large_string()))
    return runs(lower, _IS_WORD)


def runs(column: pa.Array | pa.ChunkedArray, kinds: np.ndarray) -> Words:
    """Maximal runs of the bytes for which kinds is true, as they are."""
    data, bounds = utf8(string_array(column))
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none, data)
    inside = kinds[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * _power_table(_BASE_INV, n)[starts])
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends, data)


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and their bounds. A text of 1
    to k-1 words has one shingle, all of its words; one without words has none."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(count, out=out[1:])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    total = len(hashes)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(at), dtype=np.uint64)
        short = size < k
        some_short = bool(short.any())
        for j in range(k):
            here = hashes[np.minimum(at + j, total - 1)]
            if some_short:
                here = np.where(j < size, here, np.uint64(0))
            acc = acc * _GRAM + here
        return mix64(acc + size.astype(np.uint64)), out


def byte_chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of column text, whole texts only."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
