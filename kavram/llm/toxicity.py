"""Operator 9, toxicity by lexicon induction.

Seed terms come from labelled documents. A word is a toxic seed if its share of
the words of toxic documents exceeds that of clean ones by a log-likelihood ratio
that is significant for one of as many tests as there are words (``alpha``), and
``min_ratio`` times at least. Each document counts a word once, and copies count
together as one document: the weight of a labelled document is one by the number
of those that share a minimum of its shingles. Clean seeds are the words that are
in most toxic documents without being more frequent there, in ``max_clean_share``
of the clean ones at most (unless all are in more); there are as many as it takes to be in as many
documents as the toxic seeds are, ``min_clean_seeds`` at least.

The graph's vertices are all words of all documents. Its edges are all pairs of words
within ``window`` words of each other, weighted by their positive pointwise mutual
information, with pair counts and both words' sums counted over all documents. A
random walk with restart from either set of seeds gives each word two probabilities
(less what a seed has from restarting), and the logarithm of their ratio is its polarity.

The lexicon has the toxic seeds and the words that have at least ``min_share`` of
the median polarity of these, are near toxic seeds significantly more often than by chance, and
are in toxic rather than clean documents by ``min_ratio`` as far as the labels tell.
A document's toxicity is the sum of its words' polarities by word of text; it is
toxic from the threshold on that separates best those labelled documents, a quarter,
that no seed was taken from.

Labelled documents are a bounded sample: ``max_labelled`` labels, by hash of the
id. Everything else covers all documents, all words and whole texts. Pairs are counted
in a few passes over the documents and kept by classes of words, as tables that each step
of the walk reads. The driver and each worker hold a few numbers for each word of the
vocabulary, but no pairs beyond those of a class.

Defined results
  * Null and empty texts, and texts without lexicon words, have toxicity 0.
  * Labels that are null, or of ids that occur with both labels, don't count;
    repeated labels count once. Rows of documents are scored each by itself;
    null ids stay null. Without labels of both kinds, or without a significant
    word, there are no seeds: every toxicity is 0 and no document is toxic. With
    toxic seeds, but no clean ones, the lexicon is the toxic seeds, all of one weight.
  * Only id, text and label columns are read. Empty tables give no rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .near_dedup import minima
from .quality_rules import _places
from .storage import removed, written


@dataclass(frozen=True)
class Settings:
    window: int = 10
    max_labelled: int = 20_000
    alpha: float = 0.01
    min_ratio: float = 3.0
    max_clean_share: float = 0.05
    min_clean_seeds: int = 64
    restart: float = 0.15
    steps: int = 20
    min_share: float = 0.5
    #: What a toxic seed counts in documents at least, whatever its polarity.
    min_weight: float = 0.5


#: Pairs that a part holds before it gives its counts.
_PART = 12_000_000
#: Parts of a class that are added up at once.
_GROUP = 64
#: Pairs are counted in passes over the documents of at least so many pairs on average, so that only one pass's are in a
#: shuffle at once; in so many passes at most.
_PASS = 25_000_000
_PASSES = 5
#: Pairs, repeated ones too, of a class of words.
_CLASS = 3_000_000
#: Pairs of a class that are multiplied at once.
_STRIDE = 1 << 15
#: Numbers in a row of a vector.
_SLICE = 1 << 20
#: Minima by which copies among the labelled documents are known.
_COPY_MINIMA = 4
_WHOLE = 720_720  # a document's weight, divided by its number of copies


def document_words(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text."""
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[new], h[new]


def _added(keys: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each n of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in n)


# --- seeds, from the labelled sample


def _sample(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str, text: str, label: str) -> DataFrame:
    """(key, toxic, t) of the labelled documents."""
    clear = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    some = clear.where("low = high").select("i", (F.col("low") > 0).alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(s.max_labelled)
    found = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(some), "i")
    return written(found.select(F.xxhash64("i", "t").alias("key"), "toxic", "t"), "toxic-sample")


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.byte_chunks(batches, 2):
        w = K.words(batch.column(2))
        hashes, bounds = K.grams(w.hashes, w.bounds, 3)
        rows = np.flatnonzero(np.diff(bounds))
        if len(rows):
            least = minima(hashes, np.append(bounds[rows], bounds[-1]), _COPY_MINIMA).view(np.int64)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *(pa.array(x) for x in least.T)], ["key", "toxic", *(f"m{j}" for j in range(_COPY_MINIMA))])


def copy_weights(least: np.ndarray) -> np.ndarray:
    """By row of minima: _WHOLE by the number of rows that share one of them, the largest such number."""
    most = np.ones(len(least), np.int64)
    for column in least.T:
        _, back, n = np.unique(column, return_inverse=True, return_counts=True)
        most = np.maximum(most, n[back])
    return _WHOLE // most


def _sample_words(keys: np.ndarray, weights: np.ndarray):
    """(word, toxic, n): weights of the documents that each word is in; keys sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[bool, list] = {True: [], False: []}
        for batch in K.byte_chunks(batches, 2):
            text, words = document_words(K.words(batch.column(2)))
            toxic = np.array(batch.column(1).to_pylist(), dtype=bool)
            own = np.append(weights, 0)[_places(keys, batch.column(0).to_numpy())]
            for kind, held in parts.items():
                some = (toxic[text] == kind) & (own[text] > 0)
                held.append((words[some], own[text][some]))
                if len(held) >= 32:
                    held[:] = [_added(*(np.concatenate(x) for x in zip(*held)))]
        for kind, held in parts.items():
            if held:
                words, n = _added(*(np.concatenate(x) for x in zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.full(len(words), kind)), pa.array(n)], ["word", "toxic", "n"])

    return run


def critical(alpha: float, tests: int) -> float:
    """What a log-likelihood ratio of one degree of freedom exceeds by chance in one of so many tests with probability alpha."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if erfc(sqrt(middle / 2)) > alpha / max(tests, 1) else (low, middle)
    return high


def _term(n, expected):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, n * np.log(n / expected), 0)


def ratios(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Each word's share of the toxic documents' words by that of the clean ones', half a document added."""
    return (toxic + 0.5) / max(toxic.sum(), 1) / ((clean + 0.5) / max(clean.sum(), 1))


def seed_terms(toxic: np.ndarray, clean: np.ndarray, n_clean: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of the toxic and the clean seeds, from the documents that each word is in."""
    n1, n0 = toxic.sum(), clean.sum()
    if not n1 or not n0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share, ratio = (toxic + clean) / (n1 + n0), ratios(toxic, clean)
    llr = 2 * (_term(toxic, n1 * share) + _term(clean, n0 * share))
    bad = np.flatnonzero((llr >= critical(s.alpha, len(toxic))) & (ratio >= s.min_ratio) & (toxic * n0 > clean * n1))
    even = (toxic * n0 <= 1.5 * clean * n1) & (toxic > 0)
    rare = even & (clean <= s.max_clean_share * n_clean)
    fine = np.flatnonzero(rare if rare.any() else even)
    fine = fine[np.argsort(-toxic[fine], kind="stable")]
    reach = np.cumsum((toxic + clean)[fine])
    enough = int(np.searchsorted(reach, (toxic + clean)[bad].sum())) + 1
    return bad, fine[: max(s.min_clean_seeds, enough)]


# --- the graph: pair counts of all documents, by classes of words


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers by their low bytes, one plane after the other; those that need more bytes come first, with their places."""
    large = np.flatnonzero(x >> (8 * width))
    low = [((x >> (8 * j)) & 255).astype(np.uint8).tobytes() for j in range(width)]
    raw = b"".join([np.int64(len(large)).tobytes(), large.tobytes(), x[large].tobytes(), *low])
    return raw + bytes(-len(raw) % 8)


def _numbers(flat: np.ndarray, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    """What _planes was given, and where it ends."""
    large = int(flat[at : at + 8].view(np.int64)[0])
    at += 8
    places, values = flat[at : at + 16 * large].view(np.int64).reshape(2, -1)
    at += 16 * large
    x = flat[at + (width - 1) * n : at + width * n].astype(np.int64)
    for j in reversed(range(width - 1)):
        x <<= 8
        x |= flat[at + j * n : at + (j + 1) * n]
    x[places] = values
    return x, at + width * n + -width * n % 8


def pack(keys: np.ndarray, n: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys by their gaps, and a number of each: size, and compressed bytes."""
    raw = np.int64(len(keys)).tobytes() + _planes(np.diff(keys, prepend=0), 3) + _planes(n, 1)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(size: int, raw: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(pa.decompress(raw.as_buffer(), size, codec="zstd"), np.uint8)
    count = int(flat[:8].view(np.int64)[0])
    gaps, at = _numbers(flat, 8, count, 3)
    return np.cumsum(gaps, out=gaps), _numbers(flat, at, count, 1)[0]


_COUNTS = "block int, size int, data binary"


def _row(block: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size, data = pack(keys, n)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([size], pa.int32()), pa.array([data], pa.binary())], ["block", "size", "data"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, (block, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        yield block, *unpack(size, batch.column(2)[i])


def _sums(window: int):
    """(word, n): how many words are within the window of each word, by part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows():
            words, n = _added(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in K.byte_chunks(batches, 0):
            w = K.words(batch.column(0))
            words, back = np.unique(w.hashes, return_inverse=True)
            size = np.diff(w.bounds)
            before = np.arange(len(back)) - np.repeat(w.bounds[:-1], size)
            near = np.minimum(before, window) + np.minimum(np.repeat(size, size) - 1 - before, window)
            held.append((words, np.bincount(back, weights=near, minlength=len(words)).astype(np.int64)))
            if len(held) > _GROUP:
                held[:] = [_added(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > _PART // 4:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


@dataclass(frozen=True)
class Classes:
    """How pairs of word numbers are kept. Numbers go from frequent to rare words. A pair belongs to the class of its
    rarer word, number % count; its key is the other word's number, then number // count in so many bits. Each pass
    counts fewer classes than the one before: the later it is, the more is kept already beside what it shuffles."""

    words: int
    passes: int
    blocks: int

    @property
    def count(self) -> int:
        return self.passes * self.blocks

    @property
    def bits(self) -> int:
        return (self.words // self.count).bit_length()

    @property
    def high(self) -> int:
        return self.words.bit_length() + self.bits

    def of_pass(self, own: int) -> tuple[int, int]:
        """The first class of a pass, and the first that comes after it: each pass has two thirds of what the last one had."""
        whole = 3**self.passes - 2**self.passes
        return tuple(self.count * (3**self.passes - 3 ** (self.passes - k) * 2**k) // whole for k in (own, own + 1))

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The frequent word's number, and the rarer one's // count."""
        return keys >> self.bits, keys & ((1 << self.bits) - 1)


def pairs(w: K.Words, number: np.ndarray, window: int, own: int, c: Classes) -> list[np.ndarray]:
    """Keys of the pairs of one pass, those with their block above their bits: one for each time that two words are within the
    window of each other (two for a word with itself, as it is on either side)."""
    low, end = c.of_pass(own)
    block = number % c.count
    at = np.flatnonzero((block >= low) & (block < end))
    rare = number[at]
    base = ((block[at] - low).astype(np.int64) << c.high) | (rare // c.count)
    # a window's width of numbers above all others is around each text
    texts = len(w.bounds) - 1
    text = np.repeat(np.arange(texts), np.diff(w.bounds))
    spread = np.full(len(number) + window * (texts + 1), np.iinfo(number.dtype).max, number.dtype)
    spread[np.arange(len(number)) + window * (text + 1)] = number
    at += window * (text[at] + 1)
    out = []
    for step in [*range(-window, 0), *range(1, window + 1)]:
        other = spread[at + step]
        less = other <= rare
        keys = other[less].astype(np.int64)
        keys <<= c.bits
        keys |= base[less]
        out.append(keys)
    return out


def finder(known: np.ndarray):
    """A function as _places(known, _), for many hashes: they are even, so that their high bits tell about where they are."""
    high = np.uint64(64 - max(len(known).bit_length(), 1))
    starts = np.zeros((1 << (64 - int(high))) + 1, np.int32 if len(known) < 1 << 31 else np.int64)
    np.cumsum(np.bincount((known >> high).astype(np.int64), minlength=len(starts) - 1), out=starts[1:])
    ended = np.append(known, np.uint64(2**64 - 1))

    def find(hashes: np.ndarray) -> np.ndarray:
        at = starts[(hashes >> high).astype(np.int64)]
        there = ended[at]
        before = np.flatnonzero(there < hashes)
        while len(before):
            at[before] += 1
            there[before] = now = ended[at[before]]
            before = before[now < hashes[before]]
        at[there != hashes] = len(known)
        return at

    return find


def _paired(numbers, window: int, own: int, c: Classes):
    """Rows of pair counts, one for each class of this pass and part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = numbers.value
        find, number = finder(known), np.append(number, number.dtype.type(0))
        low, end = c.of_pass(own)
        held = np.empty(_PART, np.int64)
        size = 0

        def flush():
            some = held[:size]
            some.sort()
            cuts = np.searchsorted(some, np.arange(end - low + 1) << c.high)
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if j > i:
                    keys = some[i:j] - (b << c.high)
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    yield _row(low + b, keys[first], np.diff(np.append(first, len(keys))))

        for batch in K.byte_chunks(batches, 0):
            w = K.words(batch.column(0))
            # words that are always alone have no number and no pairs
            for keys in pairs(w, number[find(w.hashes)], window, own, c):
                if size + len(keys) > len(held):
                    yield from flush()
                    held, size = held if len(keys) <= len(held) else np.empty(len(keys), np.int64), 0
                held[size : size + len(keys)] = keys
                size += len(keys)
        if size:
            yield from flush()

    return run


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order, and the sum of each one's numbers. Key and number are sorted as one where both
    fit in 63 bits."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    width = int(n.max(initial=0)).bit_length()
    if int(keys.max(initial=0)).bit_length() + width > 63:
        return _added(keys, n.astype(np.int64))
    keys <<= width
    keys |= n
    keys.sort()
    n = keys & ((1 << width) - 1)
    keys >>= width
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; those of one block are added up."""
    now, held, size = None, [], 0

    def total():
        return merged(held) if len(held) > 1 else held[0]

    for batch in batches:
        for block, *part in _rows(batch):
            if block != now:
                if held:
                    yield _row(now, *total())
                now, held, size = block, [], 0
            held.append(part)
            size += len(part[0])
            if len(held) > _GROUP or size > _PART:
                held = [total()]
                size = 0
    if held:
        yield _row(now, *total())


#: Logarithms of small numbers.
_LOGS = np.log(np.maximum(np.arange(4096), 1))


def pmi(n, one, other, total):
    """Positive PMI of pair counts, with the logarithms of the sums of both words and of all."""
    out = _LOGS.take(n, mode="clip")
    large = np.flatnonzero(n >= len(_LOGS))
    out[large] = np.log(n[large])
    out += total - one
    out -= other
    return np.maximum(out, 0, out=out)


def association(near, words, seeds, total):
    """Log-likelihood ratio of so many pairs with any toxic seed, from both sides' sums; 0 where they are fewer than by chance."""
    expected = words * seeds / total
    return np.where(near > expected, 2 * (_term(near, expected) - (near - expected)), 0)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """The shuffle of each query leaves the disk when the query ends. Otherwise the last one stays until the next has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Graph:
    """The graph of all words: the counts of all pairs, kept by classes in tables. Words are numbered from frequent to rare ones."""

    def __init__(self, docs: DataFrame, seeds: np.ndarray, window: int):
        """docs: one column of text."""
        self.spark = docs.sparkSession
        self.cores = self.spark.sparkContext.defaultParallelism
        with _shuffles_removed(self.spark):
            counts = docs.mapInArrow(_sums(window), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        words, sums = counts["word"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        del counts
        self._freed()
        some = (sums > 0) | (_places(seeds, words) < len(seeds))
        order = np.lexsort((words[some], -sums[some]))
        self.words, self.sums = words[some][order], sums[some][order]
        self.total = int(self.sums.sum())
        passes = min(_PASSES, 1 + self.total // 2 // _PASS)
        self.classes = c = Classes(len(self.words), passes, 1 + self.total // 2 // (passes * _CLASS))
        order = np.argsort(self.words)
        numbers = self.spark.sparkContext.broadcast((self.words[order], order.astype(np.int32)))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables = []
        for own in range(passes):
            rows = docs.mapInArrow(_paired(numbers, window, own, c), _COUNTS).repartition(parts, "block").sortWithinPartitions("block")
            with _shuffles_removed(self.spark):
                self.tables.append(written(rows.mapInArrow(_summed, _COUNTS), "toxic-pairs"))
            del rows
            self._freed()
        numbers.destroy()
        self.logs = self.spark.sparkContext.broadcast(np.log(np.maximum(self.sums, 1)).astype(np.float32))
        self.degree = self._product(np.ones((1, len(self.words))), np.float64, True)[0]

    def _freed(self) -> None:
        """Vectors leave the driver's memory when the JVM finds that nothing refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _product(self, x: np.ndarray, kind: type, weighed: bool) -> np.ndarray:
        """Rows of x by the matrix of positive PMI, or else of pair counts; numbers are sent as kind."""
        c, total, known = self.classes, float(np.log(max(self.total, 1))), self.logs
        sent = self.spark.sparkContext.broadcast(x.astype(kind))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, logs = sent.value.astype(np.float64), known.value
            out = np.zeros(x.shape)
            for batch in batches:
                for block, keys, n in _rows(batch):
                    own = np.arange(block, c.words, c.count)
                    # of the class's words: numbers to send, those that come, and logarithms; all of 8 bytes, as numpy is slow where it converts
                    mine, got, log = np.ascontiguousarray(x[:, own]), np.zeros((len(x), len(own))), logs[own].astype(np.float64)
                    for i in range(0, len(keys), _STRIDE):
                        one, other = c.split(keys[i : i + _STRIDE])
                        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
                        rows, size = one[first], np.diff(np.append(first, len(one)))
                        count = n[i : i + _STRIDE]
                        weight = pmi(count, np.repeat(logs[rows].astype(np.float64), size), log.take(other), total) if weighed else count.astype(np.float64)
                        for y, m, g, to in zip(x, mine, got, out):
                            to[rows] += np.add.reduceat(weight * m.take(other), first)
                            g += np.bincount(other, weights=weight * np.repeat(y[rows], size), minlength=len(g))
                    itself = _places(keys, own << c.bits | np.arange(len(own)))
                    some = itself < len(keys)
                    count = n[itself[some]]
                    got[:, some] -= (pmi(count, log[some], log[some], total) if weighed else count) * mine[:, some]  # a word's edge to itself counts once
                    out[:, own] += got
            for i in range(0, c.words, _SLICE):
                part = out[:, i : i + _SLICE]
                some = part.any(axis=0)
                if some.any():
                    values = [pa.array([v.tobytes()], pa.binary()) for v in (np.packbits(some), part[:, some].astype(kind))]
                    yield pa.RecordBatch.from_arrays([pa.array([i]), *values], ["at", "some", "data"])

        table = reduce(DataFrame.union, self.tables).coalesce(self.cores)
        got = table.mapInArrow(run, "at long, some binary, data binary").toArrow()
        sent.destroy()
        out = np.zeros(x.shape)
        for at, some, data in zip(got["at"].to_pylist(), got["some"], got["data"]):
            places = at + np.flatnonzero(np.unpackbits(np.frombuffer(some.as_buffer(), np.uint8)))
            out[:, places] += np.frombuffer(data.as_buffer(), kind).reshape(len(x), -1)
        del got, data, some
        self._freed()
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """What the words get when they send x, by row; to seven digits."""
        return self._product(x, np.float32, True)

    def near(self, of: np.ndarray) -> np.ndarray:
        """How often each word is within the window of one of those."""
        return self._product(of[None].astype(np.float64), np.float64, False)[0]

    def removed(self) -> None:
        removed(*self.tables)
        self.logs.destroy()


def walk(graph, start: np.ndarray, s: Settings) -> np.ndarray:
    """Probabilities of the words in the long run, by row of start (each sums up to one). The walk's matrix is symmetric
    when words count by one over their degree, so this is solved by conjugate gradients: until a step of the walk changes no
    probability by more than a tenth of what so many steps may leave of a difference (or the digits that vectors are sent
    with), but in so many steps at most."""
    close = max((1 - s.restart) ** s.steps / 10, 1e-6)
    inverse = np.divide(1, graph.degree, out=np.zeros_like(graph.degree), where=graph.degree > 0)
    at = s.restart * start + (1 - s.restart) * graph.degree / max(graph.degree.sum(), 1e-300)
    at[:, inverse == 0] = s.restart * start[:, inverse == 0]  # words without an edge

    def stepped(x):
        return (1 - s.restart) * graph.times(x * inverse)

    rest = s.restart * start + stepped(at) - at
    size, to = (rest * rest * inverse).sum(axis=1), rest
    for _ in range(s.steps - 1):
        if np.all(np.abs(rest) <= close * (np.abs(at) + _least(at))):
            break
        less = to - stepped(to)
        far = size / np.maximum((to * less * inverse).sum(axis=1), 1e-300)
        at, rest = at + far[:, None] * to, rest - far[:, None] * less
        last, size = size, (rest * rest * inverse).sum(axis=1)
        to = rest + (size / np.maximum(last, 1e-300))[:, None] * to
    return at


def _least(at: np.ndarray) -> float:
    """A thousandth of a word's even share."""
    return 1e-3 / at.shape[1]


def log_ratio(at: np.ndarray) -> np.ndarray:
    """Polarity of each word from two probabilities, each with a little added."""
    return np.log((at[0] + _least(at)) / (at[1] + _least(at)))


# --- documents


def scores(column: pa.Array, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = K.words(column)
    value = np.append(weights, 0)[_places(known, w.hashes)]
    total = np.concatenate([[0], np.cumsum(value)])
    return np.diff(total[w.bounds]) / np.maximum(np.diff(w.bounds), 1)


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the largest sum of sensitivity and specificity, halfway between two scores."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], toxic[order]
    gain = np.cumsum(y) / max(y.sum(), 1) - np.cumsum(~y) / max((~y).sum(), 1)
    last = np.append(s[1:] != s[:-1], True)
    gain = np.where(last & (s > 0), gain, -1)
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return float("inf")
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


@dataclass
class Lexicon:
    """Sorted word hashes with their polarities, and the threshold for documents."""

    words: np.ndarray
    weights: np.ndarray
    threshold: float


def held_out(keys: np.ndarray) -> np.ndarray:
    """The quarter of the labelled documents that no seed is taken from."""
    return K.mix64(keys.view(np.uint64)) % np.uint64(4) == 0


def lexicon_of(docs: DataFrame, vocabulary: np.ndarray, by: np.ndarray, n_clean: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(words, weights) from docs' one column of text. vocabulary: the sample's words, sorted;
    by: (words, 2) toxic and clean documents that each is in."""
    bad, fine = seed_terms(by[:, 0], by[:, 1], n_clean, s)
    if not len(bad) or not len(fine):
        return vocabulary[bad], np.ones(len(bad))
    graph = Graph(docs, vocabulary[np.sort(np.concatenate([bad, fine]))], s.window)
    toxic, clean = (np.isin(graph.words, vocabulary[x]) for x in (bad, fine))
    start = np.stack([toxic / toxic.sum(), clean / clean.sum()])
    near = graph.near(toxic)
    at = walk(graph, start, s)
    graph.removed()
    polarity = log_ratio(np.maximum(at - s.restart * start, 0))
    cut, least = s.min_share * float(np.median(polarity[toxic])), critical(s.alpha, len(graph.words))
    spoken = vocabulary[ratios(by[:, 0], by[:, 1]) < s.min_ratio]
    some = (polarity >= cut) & (association(near, graph.sums, int(graph.sums[toxic].sum()), graph.total) >= least)
    some &= ~clean & (_places(spoken, graph.words) == len(spoken))
    some |= toxic
    order = np.argsort(graph.words[some])
    return graph.words[some][order], np.maximum(polarity[some], s.min_weight)[order]


def induce(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    none = Lexicon(np.zeros(0, np.uint64), np.zeros(0), float("inf"))
    sample = _sample(docs, labels, s, doc_id, text, label)
    copies = sample.mapInArrow(_copy_keys, "key long, toxic boolean, " + ", ".join(f"m{j} long" for j in range(_COPY_MINIMA))).toArrow()
    keys, back = np.unique(copies["key"].to_numpy(), return_index=True)  # a repeated row counts once
    toxic = np.array(copies["toxic"].to_pylist(), dtype=bool)[back]
    fit = ~held_out(keys)
    if not (toxic[fit].any() and (~toxic[fit]).any() and toxic[~fit].any() and (~toxic[~fit]).any()):
        fit = np.ones(len(keys), dtype=bool)  # too few labels to hold some back
    if not toxic.any() or toxic.all():
        removed(sample)
        return none
    least = np.stack([copies[f"m{j}"].to_numpy()[back] for j in range(_COPY_MINIMA)], axis=1)
    weights = np.zeros(len(keys), np.int64)
    weights[fit] = copy_weights(least[fit])
    once = sample.dropDuplicates(["key"])
    counts = once.mapInArrow(_sample_words(keys, weights), "word long, toxic boolean, n long").groupBy("word").agg(*(F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0)).alias(n) for x, n in ((True, "a"), (False, "b")))).toArrow()
    vocabulary = counts["word"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    by = np.stack([counts[x].to_numpy()[order] / _WHOLE for x in "ab"], axis=1)
    words, value = lexicon_of(docs.select(F.col(text).alias("t")), vocabulary[order], by, weights[fit & ~toxic].sum() / _WHOLE, s)
    judge = np.ones(len(keys), dtype=bool) if fit.all() else ~fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2), words, value))], ["key", "toxic", "score"])

    if not len(words):
        removed(sample)
        return none
    got = sample.mapInArrow(run, "key long, toxic boolean, score double").toArrow()
    removed(sample)
    some = np.append(judge, False)[_places(keys, got["key"].to_numpy())]
    threshold = best_threshold(got["score"].to_numpy()[some], np.array(got["toxic"].to_pylist(), dtype=bool)[some])
    return Lexicon(words, value, threshold)


def scored(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, toxicity, toxic) of every row of docs."""
    lexicon = induce(docs, labels, s, doc_id, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 1):
            score = scores(batch.column(1), lexicon.words, lexicon.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= lexicon.threshold)], ["doc_id", "toxicity", "toxic"])

    slim = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, toxicity double, toxic boolean")
