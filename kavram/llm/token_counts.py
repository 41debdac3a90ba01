"""Operator 10, token counts by trie-shared dynamic programming.

A text's pre-tokens are its maximal runs without white space, each with the
word mark in front. The number of tokens of a pre-token is that of its best
segmentation under a unigram model over the pieces of a public vocabulary. The
vocabulary file holds ranks, not probabilities, so the model is Zipf's and of our
own making, not one that a published tokenizer uses: the piece of rank r has
probability in proportion to 1/(r + 2.7). Bytes that no
piece covers are byte tokens, less likely by far than any piece.

The distinct pre-tokens of about ``chunk_bytes`` of text are put in a trie, all at
once: sorted, each shares the nodes of its common prefix with the one before it.
Forward scores are computed for each node once, from those of the nodes above it:
level by level while a level is wide, all of its nodes at a time, and down one
branch after the other beneath, from where it leaves the branch before. Every
pre-token's terminal count is then added up by document. Scores are whole numbers,
so equal sums are equal; of equally good segmentations the one of fewer tokens counts.

Defined results
  * Null, empty and white texts have 0 tokens. Every row is counted, repeated
    ones each; null ids stay null. Only id and text are read. An empty table
    gives no rows. White space is ASCII's; case isn't changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

MARK = "▁"
_NOT_WHITE = np.ones(256, dtype=bool)
_NOT_WHITE[list(b" \t\n\r\f\v")] = False
#: A score's unit is a millionth of a nat; a token costs one more in the last bits.
_UNIT, _TOKEN = 1_000_000, 1 << 12
_NEVER = np.int64(-(1 << 62))
#: Pre-tokens that a level must still have to be scored as a whole; characters of a branch that are matched at once.
_WIDE = 512
_SEGMENT = 1 << 16
_SLOTS = 1 << 20


@dataclass(frozen=True)
class Settings:
    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    chunk_bytes: int = 6 << 20


class Vocabulary:
    """Pieces as UTF-8 with their values, by hash."""

    def __init__(self, pieces: list[str]):
        """pieces: in the order of their ranks."""
        score = -np.log(np.arange(len(pieces)) + 2.7)
        score -= np.log(np.exp(score).sum())
        whole = np.round(score * _UNIT).astype(np.int64)
        self.values = {p.encode(): int(v) * _TOKEN - 1 for p, v in zip(pieces, whole) if p}
        self.byte = (int(whole.min()) - 10 * _UNIT) * _TOKEN - 1
        self.longest = max([4, *map(len, self.values)])
        raw = list(self.values)
        data, bounds = K.utf8(K.string_array(pa.array([p.decode() for p in raw], pa.large_string())))
        rolling = Rolling(data)
        hashes = rolling.of(bounds[:-1], bounds[1:])
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.keys = np.append(hashes[order], np.uint64(0))
        self.worth = np.append(np.array(list(self.values.values()), np.int64)[order], _NEVER)
        self.first = np.full(_SLOTS, -1, dtype=np.int32)
        ordered = slot[order]
        head = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.first[ordered[head]] = head
        self.most = int(np.diff(np.append(head, len(ordered))).max(initial=0))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the hashes that are pieces."""
        at = self.first[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)]
        some = np.flatnonzero(at >= 0)
        at, wanted = at[some].astype(np.int64), hashes[some]
        value = np.full(len(some), _NEVER)
        for j in range(self.most):
            here = np.minimum(at + j, len(self.keys) - 1)
            value = np.where(self.keys[here] == wanted, self.worth[here], value)
        hit = value != _NEVER
        return some[hit], value[hit]


class Rolling:
    """Hashes of any stretches of data."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * K._power_table(K._BASE, n)[:n], out=self.total[1:])
        self.back = K._power_table(K._BASE_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return K.mix64((self.total[end] - self.total[start]) * self.back[start])


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    """The pieces of a SentencePiece file in the order of their ids, without control, byte and unused ones."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary([sp.id_to_piece(i) for i in normal])


def count_all(sorted_data: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Tokens of each pre-token; they are distinct and sorted by their bytes."""
    n, size = len(bounds) - 1, np.diff(bounds)
    start = bounds[:-1]
    top = int(size.max(initial=0))
    out = np.zeros(n, dtype=np.int32)
    if n == 0:
        return out
    shared = np.zeros(n, dtype=np.int32)  # bytes that each has in common with the one before
    same = np.arange(1, n)
    for d in range(min(top, 64)):
        same = same[(size[same] > d) & (size[same - 1] > d)]
        same = same[sorted_data[start[same] + d] == sorted_data[start[same - 1] + d]]
        if len(same) == 0:
            break
        shared[same] = d + 1
    else:  # the few that have still more in common
        for i in same.tolist():
            k = int(min(size[i], size[i - 1]))
            differ = np.flatnonzero(sorted_data[start[i] : start[i] + k] != sorted_data[start[i - 1] : start[i - 1] + k])
            shared[i] = differ[0] if len(differ) else k
    rolling = Rolling(sorted_data)
    best = [np.zeros(n, np.int64)]  # of the last levels, by pre-token
    count = [np.zeros(n, np.int32)]
    index = np.arange(n)
    width = n - np.concatenate([[0], np.cumsum(np.bincount(size, minlength=top + 1))])  # pre-tokens of at least so many bytes
    for d in range(1, top + 1):
        if width[d] < _WIDE:
            _branches(index[size >= d], d - 1, sorted_data, bounds, shared, best, count, rolling, vocab, out)
            break
        new = np.flatnonzero((size >= d) & (shared < d))  # the nodes of this level
        value = best[-1][new] + vocab.byte
        number = count[-1][new] + 1
        end = start[new] + d
        for back in range(1, min(d, vocab.longest) + 1):
            at, worth = vocab.look_up(rolling.of(end - back, end))
            other = best[-back][new[at]] + worth
            better = other > value[at]
            at = at[better]
            value[at] = other[better]
            number[at] = count[-back][new[at]] + 1
        level, tokens = np.zeros(n, np.int64), np.zeros(n, np.int32)
        level[new], tokens[new] = value, number
        mark = np.zeros(n, dtype=np.int64)
        mark[new] = new
        owner = np.maximum.accumulate(mark)
        best.append(level[owner])
        count.append(tokens[owner])
        if len(best) > vocab.longest:
            best.pop(0)
            count.pop(0)
        done = index[size == d]
        out[done] = count[-1][done]
    return out


def _branches(which: np.ndarray, level: int, data: np.ndarray, bounds: np.ndarray, shared: np.ndarray, best: list, count: list, rolling: Rolling, vocab: Vocabulary, out: np.ndarray) -> None:
    """Goes on from level, whose scores and those of the levels above it are in best and count,
    down one pre-token after the other. Pieces are matched for many nodes at once."""
    jobs: list[tuple[int, np.ndarray, int, int, int]] = []  # (pre-token, ends, first node, last node, nodes that are known from the one before)
    path = [np.zeros(0, np.int64)] * 3  # places, scores and tokens of the last one's nodes below level
    open_parts: list[tuple[np.ndarray, ...]] = []
    scores: list[int] = []
    tokens: list[int] = []

    def flush():
        nonlocal path, open_parts, scores, tokens
        first, piece = _matches([(ends[max(0, at - vocab.longest) : stop] + bounds[i], stop - at) for i, ends, at, stop, _ in jobs], rolling, vocab)
        node = 0
        for i, ends, at, stop, keep in jobs:
            if keep >= 0:  # its first job: the nodes that are known, of which a piece's length matters
                above = ends[(ends <= level) & (ends > level - len(best))].tolist()
                scores = [int(best[p - level - 1][i]) for p in above] + path[1][max(0, keep - vocab.longest) : keep].tolist()
                tokens = [int(count[p - level - 1][i]) for p in above] + path[2][max(0, keep - vocab.longest) : keep].tolist()
                open_parts = [tuple(x[:keep] for x in path)]
            known = len(scores)
            for wide in np.diff(ends[at - 1 : stop]).tolist():
                top, n = scores[-1] + wide * vocab.byte, tokens[-1] + wide
                for back, worth in piece[first[node] : first[node + 1]]:
                    if scores[-back] + worth > top:
                        top, n = scores[-back] + worth, tokens[-back] + 1
                scores.append(top)
                tokens.append(n)
                node += 1
            open_parts.append((ends[at:stop], np.array(scores[known:], np.int64), np.array(tokens[known:], np.int64)))
            scores, tokens = scores[-vocab.longest :], tokens[-vocab.longest :]
            if stop == len(ends):
                path = [np.concatenate(x) for x in zip(*open_parts)]
                out[i] = path[2][-1]
        jobs.clear()

    before, nodes = -1, 0
    for i in which.tolist():
        raw = data[bounds[i] : bounds[i + 1]]
        ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where a character ends, and 0
        same = int(shared[before + 1 : i + 1].min()) if before >= 0 else 0
        start = int(np.searchsorted(ends, level, "right"))
        at = max(start, int(np.searchsorted(ends, same, "right")))
        keep, before = at - start, i
        while at < len(ends):
            stop = min(at + _SEGMENT, len(ends))
            jobs.append((i, ends, at, stop, keep))
            nodes += stop - at
            at, keep = stop, -1
            if nodes >= _SEGMENT:
                flush()
                nodes = 0
    if jobs:
        flush()


def _matches(parts: list[tuple[np.ndarray, int]], rolling: Rolling, vocab: Vocabulary) -> tuple[list[int], list[tuple[int, int]]]:
    """Pieces (characters, value) that end at the last n of each part's ends, and the bounds of each end's."""
    ends = np.concatenate([e for e, _ in parts])
    begin = np.cumsum([0, *(len(e) for e, _ in parts)])
    which = np.concatenate([np.arange(b - n, b) for b, (_, n) in zip(begin[1:], parts)])
    owner = np.repeat(begin[:-1], [n for _, n in parts])
    total, order = len(which), np.arange(len(which))
    found = []
    for back in range(1, vocab.longest + 1):
        some = which - back >= owner
        some[some] = ends[which[some]] - ends[which[some] - back] <= vocab.longest
        which, owner, order = which[some], owner[some], order[some]
        if len(which) == 0:
            break
        hit, worth = vocab.look_up(rolling.of(ends[which - back], ends[which]))
        found.append((order[hit], np.full(len(hit), back), worth))
    end, back, worth = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    sort = np.argsort(end, kind="stable")
    first = np.searchsorted(end[sort], np.arange(total + 1))
    return first.tolist(), list(zip(back[sort].tolist(), worth[sort].tolist()))


def tokens_of(column: pa.Array, vocab: Vocabulary) -> np.ndarray:
    """Tokens of each text."""
    runs = K.runs(column, _NOT_WHITE)
    if len(runs.hashes) == 0:
        return np.zeros(len(column), np.int64)
    _, first, back = np.unique(runs.hashes, return_index=True, return_inverse=True)
    begin, size = runs.starts[first], runs.ends[first] - runs.starts[first]
    counts = np.zeros(len(first), dtype=np.int64)
    # mark and bytes of every distinct pre-token, one after the other
    mark = np.frombuffer(MARK.encode(), np.uint8)
    length = size + len(mark)
    bounds = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    place = np.repeat(begin - len(mark), length) + at
    data = np.where(at < len(mark), mark[np.minimum(at, len(mark) - 1)], runs.data[np.maximum(place, 0)])
    array = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    order = pc.sort_indices(array)
    _, offsets, raw = array.take(order).buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(first) + 1]
    counts[order.to_numpy()] = count_all(np.frombuffer(raw, np.uint8)[: ends[-1]], ends, vocab)
    total = np.concatenate([[0], np.cumsum(counts[back])])
    return np.diff(total[runs.bounds])


def counted(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(s.model)
        for batch in K.byte_chunks(batches, 1, s.chunk_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens_of(batch.column(1), vocab), pa.int64())], ["doc_id", "n_tokens"])

    slim = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long")
