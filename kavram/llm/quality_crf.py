"""Operator 7, quality classifier: a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. A line is described by its own
measures (length, shares of kinds of characters, repetition, how it begins and
ends) and by those of the lines before and after it; the labels of neighbouring
lines are linked by transition weights. The quality of a document is the mean of
its lines' forward-backward marginals of "good", weighted by their lengths.

Training has labels of documents only. Lines start with their document's label. A
fit on each line's own measures relabels the lines of bad documents that it takes
for good (the worst line always stays bad); then the whole field is fitted and
relabels them again, for ``rounds`` rounds. The
labelled documents are a bounded sample: ``max_labelled`` labels by hash of the
id; only their lines' measures reach the driver.

Defined results
  * Null and empty texts, and texts of empty lines only, have quality null, no
    bad line, and are kept. A line of any length counts whole.
  * Repeated rows are judged each by itself; null ids stay null. Null labels and
    ids labelled both ways don't count, repeated labels count once. With labels of
    one kind only, or none, every quality is null and every document is kept.
  * Only id, text and label columns are read by ``judged``. Empty tables give
    no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .storage import written


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 2000
    rounds: int = 3
    steps: int = 80
    rate: float = 0.1
    penalty: float = 1e-3
    min_quality: float = 0.5
    chunk_bytes: int = 4 << 20


_KINDS = ("lower", "upper", "digit", "space", "stop", "shout", "bar", "symbol", "other")
_KIND = np.full(256, _KINDS.index("symbol"), dtype=np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[list(b" \t\r\f\v")] = 3
_KIND[list(b".,;:?'\"()-")] = 4
_KIND[ord("!")] = 5
_KIND[ord("|")] = 6
_KIND[0xC0:] = 8
_KIND[0x80:0xC0] = len(_KINDS)  # continuation bytes
_LINE = np.ones(256, dtype=bool)
_LINE[ord("\n")] = False
_NOT_WHITE = np.ones(256, dtype=bool)
_NOT_WHITE[list(b" \t\n\r\f\v")] = False
#: length, 8 shares (without lower), length of a word, words like the one before, repeated line, ends a sentence, begins upper
MEASURES = 14


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures, length in characters, bounds): of every line that isn't empty."""
    runs = K.runs(column, _LINE)
    n = len(runs.hashes)
    if n == 0:
        return np.zeros((0, MEASURES)), np.zeros(0), runs.bounds
    width = len(_KINDS) + 1
    size = runs.ends - runs.starts
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(row)) + np.repeat(runs.starts - (np.cumsum(size) - size), size)
    kinds = np.bincount(row * width + _KIND[runs.data[at]], minlength=n * width).reshape(n, width)[:, :-1]
    length = kinds.sum(axis=1).astype(np.float64)
    share = kinds / np.maximum(length, 1)[:, None]
    text = np.repeat(np.arange(len(runs.bounds) - 1), np.diff(runs.bounds))
    order = np.lexsort((np.arange(n), runs.hashes, text))
    again = np.zeros(n)
    again[order[1:]] = (runs.hashes[order][1:] == runs.hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    word = K.runs(column, _NOT_WHITE)
    line = np.searchsorted(runs.starts, word.starts, "right") - 1
    like = np.zeros(len(line))
    like[1:] = (word.hashes[1:] == word.hashes[:-1]) & (line[1:] == line[:-1])
    stutter = np.bincount(line, weights=like, minlength=n) / np.maximum(np.bincount(line, minlength=n), 1)
    last, first = runs.data[runs.ends - 1], runs.data[runs.starts]
    out = np.column_stack(
        [
            np.log1p(length),
            share[:, 1:],
            length / (kinds[:, 3] + 1) / 10,
            stutter,
            again,
            np.isin(last, list(b".?!")),
            (first >= 65) & (first <= 90),
        ]
    )
    return out, length, runs.bounds


def with_neighbours(measures: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A constant, each line's own measures, those of the line before and after, and whether there is none."""
    n = len(measures)
    before, after = np.zeros_like(measures), np.zeros_like(measures)
    first, last = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(bounds))
    first[bounds[some]] = 1
    last[bounds[some + 1] - 1] = 1
    if n > 1:
        before[1:] = measures[:-1] * (1 - first[1:, None])
        after[:-1] = measures[1:] * (1 - last[:-1, None])
    return np.column_stack([np.ones(n), measures, before, after, first, last])


class Chains:
    """Many sequences side by side: step t handles the t-th line of all that have one."""

    def __init__(self, bounds: np.ndarray):
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        self.first = bounds[order]
        self.size = size[order]
        top = int(self.size[0]) if len(order) else 0
        #: sequences with more than t lines; they are the first ones
        self.active = np.searchsorted(-self.size, -np.arange(top), "left")

    def steps(self) -> Iterator[np.ndarray]:
        for t, n in enumerate(self.active):
            yield self.first[:n] + t


def marginals(score: np.ndarray, transition: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of every line, and the expected numbers of the four transitions.
    score: log potential of bad against good; transition: 2 x 2, log potentials."""
    n = len(score)
    potential = np.ones((n, 2))
    potential[:, 1] = np.exp(np.clip(score, -30, 30))
    move = np.exp(transition)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    places = list(chains.steps())
    for t, at in enumerate(places):
        a = potential[at] if t == 0 else (forward[at - 1] @ move) * potential[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for at in reversed(places[1:]):
        b = potential[at] * backward[at]
        joint = forward[at - 1][:, :, None] * move[None] * b[:, None, :]
        total = joint.sum(axis=(1, 2), keepdims=True)
        pairs += (joint / total).sum(axis=0)
        b = b @ move.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class Field:
    weights: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.spread) @ self.weights

    def bad(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return marginals(self.score(features), self.transition, Chains(bounds))[0]


def fit(measures: np.ndarray, bounds: np.ndarray, bad_doc: np.ndarray, s: Settings = Settings()) -> Field:
    features = with_neighbours(measures, bounds)
    mean, spread = features.mean(axis=0), features.std(axis=0)
    mean[0], spread = 0, np.where(spread > 1e-9, spread, 1)
    x = (features - mean) / spread
    chains = Chains(bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    label = bad_doc[text].astype(np.float64)
    inner = np.ones(len(label), dtype=bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    inner = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    n = len(label)
    own = np.zeros(len(theta))
    own[: 1 + MEASURES] = 1
    for turn in range(1 + s.rounds):
        # at first a line is judged by itself: its neighbours would tell its document's label
        free = own if turn == 0 else 1
        seen = np.bincount((label[inner - 1] * 2 + label[inner]).astype(np.int64), minlength=4)
        one, two = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, s.steps + 1):
            p, pairs = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), chains)
            gradient = np.concatenate([x.T @ (label - p), seen - pairs.ravel()]) / n - s.penalty * theta
            gradient *= free
            one = 0.9 * one + 0.1 * gradient
            two = 0.99 * two + 0.01 * gradient**2
            theta = theta + s.rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        p = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), chains)[0]
        worst = np.zeros(n, dtype=bool)
        order = np.lexsort((p, text))
        worst[order[np.flatnonzero(np.diff(text[order], append=-1))]] = True
        label = (bad_doc[text] & ((p >= 0.5) | worst)).astype(np.float64)
    return Field(theta[:-4], theta[-4:].reshape(2, 2), mean, spread)


def _labelled(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures, bounds, bad) of the labelled sample, in a fixed order."""
    clear = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    some = clear.where("low = high").select("i", (F.col("low") <= 0).alias("bad")).orderBy(F.xxhash64("i"), "i").limit(s.max_labelled)
    sample = written(docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(some), "i"), "crf-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 2, s.chunk_bytes):
            m, _, bounds = lines(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds * MEASURES, pa.int32()), pa.array(m.astype(np.float32).ravel()))],
                ["key", "bad", "measures"],
            )

    rows = sample.select(F.xxhash64("i", "t").alias("key"), "bad", "t").mapInArrow(run, "key long, bad boolean, measures array<float>").collect()
    rows.sort(key=lambda r: (r.key, r.bad))
    parts = [np.array(r.measures, np.float64).reshape(-1, MEASURES) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros((0, MEASURES)), bounds, np.array([r.bad for r in rows], dtype=bool)


def trained(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Field | None:
    measures, bounds, bad = _labelled(docs, labels, s, doc_id, text, label)
    if len(measures) == 0 or bad.all() or not bad.any():
        return None
    return fit(measures, bounds, bad, s)


def qualities(column: pa.Array, field: Field | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, bad lines, quality) of each text; quality is nan where it has no lines."""
    measures, length, bounds = lines(column)
    n = np.diff(bounds)
    if field is None:
        return n, np.zeros_like(n), np.full(len(n), np.nan)
    p = field.bad(with_neighbours(measures, bounds), bounds)
    add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds])
    with np.errstate(invalid="ignore", divide="ignore"):
        quality = np.where(n > 0, add((1 - p) * length) / add(length), np.nan)
    return n, add(p >= 0.5).astype(np.int64), quality


def judged(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, n_lines, n_bad_lines, quality, keep) of every row of docs."""
    field = trained(docs, labels, s, doc_id, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 1, s.chunk_bytes):
            n, bad, quality = qualities(batch.column(1), field)
            keep = ~(quality < s.min_quality)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(quality, from_pandas=True), pa.array(keep)],
                ["doc_id", "n_lines", "n_bad_lines", "quality", "keep"],
            )

    slim = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_lines long, n_bad_lines long, quality double, keep boolean")
