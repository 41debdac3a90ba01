"""Operator 2, benchmark decontamination by size-partitioned MinHash containment search.

An item of a test set is contained in a document to the degree that the item's
``shingle``-word shingles occur in the document. Whole long documents have a
vanishing Jaccard similarity with a short item, so a MinHash of a whole document
would miss it. Items are therefore partitioned by size, and for the items of a
size class of up to ``B`` shingle positions every document is covered by windows
of two neighbouring blocks of ``B`` positions, ``B`` a power of two: an item's
passage lies whole within one window, whose Jaccard similarity with the item is
a fifth at least at containment 0.8. A window whose minimum under one of
``perms`` hash functions equals the item's is a candidate (bands of one row); at a
fifth 32 functions miss one in a thousand. Block minima of a larger class are
minima of a smaller class's, so documents are hashed once. Every candidate is
verified by exact containment of word tuples in the whole document.

Items of up to ``_LEAST / 2`` positions are the smallest class. Its windows are
single shingles, whose minimum is the shingle itself under any function, so one
look-up of every shingle among these items' shingles finds all candidates.

Items travel to the tasks in groups of ``group_bytes`` of text. A larger test set
makes more scans of the documents, one a group, never a larger broadcast.

Defined results
  * An item of fewer words than a shingle is one shingle, all of its words.
    Items without words (null, empty) and documents without words never match.
  * Items with equal id and text count once. Every row of documents is searched:
    repeated rows give repeated results. Null ids are carried along.
  * Other columns aren't read by ``leaks``, and are kept by ``clean``.
    Empty tables give empty results; nothing is cut from long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .near_dedup import _multipliers


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    perms: int = 32
    min_containment: float = 0.8
    group_bytes: int = 4 << 20


#: Positions of the smallest block of which minima are taken.
_LEAST = 16


class Items:
    """A group of items, indexed. Classes are keyed by (words of a shingle, block)."""

    def __init__(self, ids: list, texts: list[str], s: Settings):
        w = K.words(pa.array(texts, pa.large_string()))
        self.ids, self.settings = ids, s
        self.sets: list[frozenset] = []
        self.width: list[int] = []
        members: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        small: dict[int, list[tuple[int, int]]] = {}
        factors = _multipliers(s.perms)
        for i, (a, b) in enumerate(zip(w.bounds, w.bounds[1:])):
            k = min(s.shingle, int(b - a))
            self.width.append(k)
            self.sets.append(frozenset(tuples(w.text(a, b), k)) if k else frozenset())
            if k:
                hashes, _ = K.grams(w.hashes[a:b], np.array([0, b - a]), k)
                if len(hashes) <= _LEAST // 2:
                    small.setdefault(k, []).extend((h, i) for h in set(hashes.tolist()))
                    continue
                block = 1 << int(len(hashes) - 1).bit_length()
                with np.errstate(over="ignore"):
                    members.setdefault((k, block), []).append((i, (hashes[:, None] * factors[None]).min(axis=0)))
        self.small = {k: (np.array([h for h, _ in v], np.uint64), np.array([i for _, i in v])) for k, v in ((k, sorted(v)) for k, v in small.items())}
        self.classes: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (k, block), found in sorted(members.items()):
            least = np.array([m for _, m in found])
            order = np.argsort(least, axis=0)
            which = np.array([i for i, _ in found])[order]
            self.classes.setdefault(k, []).append((block, np.take_along_axis(least, order, 0), which))

    def hits(self, column: pa.Array) -> list[tuple[int, int, float]]:
        """(row, item, containment) of a chunk of documents."""
        s, w = self.settings, K.words(column)
        factors = _multipliers(s.perms)
        pairs: set[tuple[int, int]] = set()
        for k in sorted({*self.small, *self.classes}):
            hashes, bounds = K.grams(w.hashes, w.bounds, k)
            if len(hashes) == 0:
                continue
            if k in self.small:
                at, item = _equal(*self.small[k], hashes)
                pairs.update(zip((np.searchsorted(bounds, at, "right") - 1).tolist(), item.tolist()))
            classes = self.classes.get(k)
            if not classes:
                continue
            base = classes[0][0]
            cuts, owner = _blocks(bounds, base)
            levels = []
            for block, least, which in classes:
                steps, docs = (np.arange(len(cuts)), owner) if block == base else _blocks(np.searchsorted(cuts, bounds), block // base)
                levels.append((steps, docs, np.append(docs[1:] == docs[:-1], False), least, which))
            for p in range(s.perms):
                with np.errstate(over="ignore"):
                    small = np.minimum.reduceat(hashes * factors[p], cuts)
                for steps, docs, more, least, which in levels:
                    block_min = small if len(steps) == len(small) else np.minimum.reduceat(small, steps)
                    window = block_min.copy()
                    window[:-1][more[:-1]] = np.minimum(block_min[:-1], block_min[1:])[more[:-1]]
                    at, item = _equal(least[:, p], which[:, p], window)
                    pairs.update(zip(docs[at].tolist(), item.tolist()))
        out, cache = [], {}
        for d, i in sorted(pairs):
            key = (d, self.width[i])
            if key not in cache:
                cache = {q: v for q, v in cache.items() if q[0] == d}
                cache[key] = set(tuples(w.text(w.bounds[d], w.bounds[d + 1]), self.width[i]))
            share = len(self.sets[i] & cache[key]) / len(self.sets[i])
            if share >= s.min_containment:
                out.append((d, i, share))
        return out


def _equal(keys: np.ndarray, of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in values, of[i]) of every value that equals keys[i]; keys are sorted."""
    first = np.searchsorted(keys, values)
    hit = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == values)
    count = np.searchsorted(keys, values[hit], "right") - first[hit]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(hit, count), of[np.repeat(first[hit], count) + within]


def tuples(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(k))))


def _blocks(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of size that each range of bounds is cut into, and each block's range."""
    count = -(-np.diff(bounds) // size)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return bounds[:-1][owner] + (np.arange(len(owner)) - first[owner]) * size, owner


def _groups(items: DataFrame, s: Settings, item_id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for row in items.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().sort("i", "t").toLocalIterator():
        if size and size + len(row.t) > s.group_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t) + 16
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment): every document and item of at least min_containment."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    kind = items.schema[item_id].dataType
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item long, containment double"
    out = spark.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {kind.simpleString()}, containment double")
    for ids, texts in _groups(items, s, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Items(ids, texts, s)
            for batch in K.byte_chunks(batches, 1):
                found = index.hits(batch.column(1))
                if found:
                    row, item, share = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(np.round(share, 6))], ["doc_id", "item", "containment"])

        names = F.array(*[F.lit(i).cast(kind) for i in ids]) if len(ids) <= 1000 else None
        found = slim.mapInArrow(run, schema)
        if names is None:
            lookup = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind.simpleString()}")
            found = found.join(lookup, "item")
        else:
            found = found.withColumn("item_id", F.get(names, F.col("item").cast("int")))
        out = out.union(found.select("doc_id", "item_id", "containment"))
    return out


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, all columns as they are."""
    at = docs.columns.index(text)
    for ids, texts in _groups(items, s, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Items(ids, texts, s)
            for batch in K.byte_chunks(batches, at):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, _, _ in index.hits(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
