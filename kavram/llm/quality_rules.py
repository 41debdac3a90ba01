"""Operator 1, quality rules by distribution divergence.

Each document's histogram over character classes and over the common words of
its language is compared with the reference of that language by Jensen-Shannon
distance (base 2, so from 0 to 1). References are counted over all documents.

A word is *common* in a language if it makes up at least ``common_share`` of
all the language's words; so a language has at most ``1/common_share`` of them,
however large the corpus is. They are found exactly in two passes without
shuffling the vocabulary: the first keeps a summary of ``1/common_share`` words a
language of each part, and of parts put together, from which as much is taken as
the next frequent word has; so a word that is common is never lost, and the driver
gets no more than such a summary. The second pass counts only its words.

A histogram of n words is by chance as far from its source as a constant by the
root of n, so the word distance may be ``max_word_distance + word_noise / sqrt(n)``.

Defined results
  * Guards: with fewer than ``min_chars`` characters or ``min_words`` words the
    respective distance is null and can't reject; so null, empty and very short
    texts are kept.
  * A language with fewer than ``min_reference_words`` words is no reference;
    its documents' distances are null. Documents without a language form a
    language of their own.
  * Repeated rows and equal doc_ids are judged each by itself. No row is
    dropped or added; only the id, text and language columns are read, so other
    columns' names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

#: a-z, A-Z, 0-9, white space, sentence punctuation, other ASCII, beyond ASCII
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
_PUNCTUATION = b".,;:!?'\"()-"
_SKIP = len(CLASSES)  # UTF-8 continuation bytes count for no class
_CLASS = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b" \t\n\r\f\v")] = 3
_CLASS[list(_PUNCTUATION)] = 4
_CLASS[0x80:0xC0] = _SKIP
_CLASS[0xC0:] = 6

#: Words that a part of the first pass holds before it gives its candidates.
_PART_WORDS = 2_000_000


@dataclass(frozen=True)
class Rules:
    common_share: float = 0.005
    min_chars: int = 200
    min_words: int = 50
    min_reference_words: int = 1000
    max_char_distance: float = 0.3
    max_word_distance: float = 0.12
    word_noise: float = 2.6


def class_counts(column: pa.Array) -> np.ndarray:
    data, bounds = K.utf8(K.string_array(column))
    width, n = len(CLASSES) + 1, len(bounds) - 1
    row = np.repeat(np.arange(n) * width, np.diff(bounds))
    return np.bincount(row + _CLASS[data], minlength=n * width).reshape(n, width)[:, :-1]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts q."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = (q / q.sum())[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    langs = np.array([x or "" for x in batch.column(1).to_pylist()], dtype=object)
    for lang in sorted(set(langs)):
        yield lang, np.flatnonzero(langs == lang)


def _members(w: K.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of these texts, and for each the place of its text in rows."""
    count = np.diff(w.bounds)
    chosen = np.zeros(len(count), dtype=bool)
    chosen[rows] = True
    word = np.repeat(chosen, count)
    return w.hashes[word], np.repeat(np.arange(len(rows)), count[rows])


def summary(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most size of distinct words, among them every one that has more than 1/(size+1)
    of all counts: what the next frequent word has is taken from each (Misra and Gries)."""
    if len(words) <= size:
        return words, counts
    left = counts - np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]
    return words[left > 0], left[left > 0]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


_CANDIDATES = "lang string, part int, word long, n long"


def _rows_of(found: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    langs = [k[0] for k, (w, _) in found.items() for _ in range(len(w))]
    parts = [k[1] for k, (w, _) in found.items() for _ in range(len(w))]
    words, counts = (np.concatenate([x[i] for x in found.values()] or [np.zeros(0, np.int64)]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.int32()), pa.array(words.view(np.int64)), pa.array(counts)], ["lang", "part", "word", "n"])


def _candidates(size: int):
    """A summary of the words of each language, by part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def flush():
            found = {(lang, part): summary(*_merged(own), size) for lang, own in held.items()}
            held.clear()
            return _rows_of(found)

        for batch in K.byte_chunks(batches, 0):
            w = K.words(batch.column(0))
            for lang, rows in _by_language(batch):
                own = np.unique(_members(w, rows)[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append(own)
                n += len(own[0])
                if len(parts) >= 32:
                    n -= sum(len(h) for h, _ in parts)
                    parts[:] = [_merged(parts)]
                    n += len(parts[0][0])
            if n > _PART_WORDS:
                yield flush()
                n = 0
        if held:
            yield flush()

    return run


def _together(size: int):
    """Summaries of one language and part, put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, own in frame.groupby(["lang", "part"]):
                new = (own.word.to_numpy().view(np.uint64), own.n.to_numpy())
                held[key] = summary(*_merged([held[key], new] if key in held else [new]), size)
        if held:
            yield _rows_of(held)

    return run


def _tree(parts: DataFrame, size: int) -> DataFrame:
    """One summary a language, in three rounds, so that no task reads more than a share of the parts."""
    for most in (1024, 32, 1):
        parts = parts.withColumn("part", F.col("part") % most).repartition("lang", "part").mapInArrow(_together(size), _CANDIDATES)
    return parts


def _counts(candidates: dict[str, np.ndarray]):
    """Rows (lang, kind, item, n): class counts, counts of the candidates, and all words (item 0 of kind 'total')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in K.byte_chunks(batches, 0):
            w, classes = K.words(batch.column(0)), class_counts(batch.column(0))
            for lang, rows in _by_language(batch):
                known = candidates.get(lang, np.zeros(0, np.uint64))
                own = sums.setdefault(lang, [np.zeros(len(CLASSES), np.int64), np.zeros(len(known) + 1, np.int64), 0])
                hashes, _ = _members(w, rows)
                own[0] += classes[rows].sum(axis=0)
                own[1] += np.bincount(_places(known, hashes), minlength=len(known) + 1)
                own[2] += len(hashes)
        out = [
            (lang, kind, item, int(n))
            for lang, (classes, common, total) in sums.items()
            for kind, items, counts in (
                ("class", range(len(CLASSES)), classes),
                ("word", candidates.get(lang, np.zeros(0, np.uint64)).view(np.int64).tolist(), common[:-1]),
                ("total", [0], [total]),
            )
            for item, n in zip(items, counts)
        ]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "kind", "item", "n"])

    return run


def _places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted known, or len(known)."""
    if len(known) == 0:
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language: (class counts, sorted hashes of the common words, their counts with the rest last)."""
    slim = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"))
    found: dict[str, list[int]] = {}
    size = ceil(1 / rules.common_share)
    for row in _tree(slim.mapInArrow(_candidates(size), _CANDIDATES), size).collect():
        found.setdefault(row.lang, []).append(row.word)
    candidates = {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in found.items()}
    table: dict[str, dict[str, dict[int, int]]] = {}
    summed = slim.mapInArrow(_counts(candidates), "lang string, kind string, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        table.setdefault(row.lang, {}).setdefault(row.kind, {})[row.item] = row.n
    out = {}
    for key, kinds in table.items():
        total = kinds["total"][0]
        if total < rules.min_reference_words:
            continue
        common = {w: n for w, n in kinds.get("word", {}).items() if n >= rules.common_share * total}
        hashes = np.array(list(common), np.int64).view(np.uint64)
        order = np.argsort(hashes)
        counts = np.array(list(common.values()), np.float64)[order]
        out[key] = (np.array([kinds["class"][i] for i in range(len(CLASSES))], np.float64), hashes[order], np.append(counts, total - counts.sum()))
    return out


def _judge(refs: dict, rules: Rules):
    def distances(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """batch: (text, lang). Distances are nan where a guard holds."""
        n = batch.num_rows
        w, classes = K.words(batch.column(0)), class_counts(batch.column(0))
        chars, count = classes.sum(axis=1), np.diff(w.bounds)
        by_class, by_word = np.full(n, np.nan), np.full(n, np.nan)
        for lang, rows in _by_language(batch):
            if lang not in refs:
                continue
            class_ref, known, word_ref = refs[lang]
            hashes, owner = _members(w, rows)
            width = len(known) + 1
            found = np.bincount(owner * width + _places(known, hashes), minlength=len(rows) * width).reshape(-1, width)
            by_class[rows] = np.where(chars[rows] >= rules.min_chars, distance(classes[rows], class_ref), np.nan)
            by_word[rows] = np.where(count[rows] >= rules.min_words, distance(found, word_ref), np.nan)
        with np.errstate(invalid="ignore"):
            most = rules.max_word_distance + rules.word_noise / np.sqrt(np.maximum(count, 1))
            keep = ~((by_class > rules.max_char_distance) | (by_word > most))
        return by_class, by_word, count, keep

    return distances


def judge(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each document: doc_id, n_words, char_distance, word_distance (rounded to 6 digits, null where a guard holds), keep."""
    distances = _judge(references(docs, rules, text, lang), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 1):
            by_class, by_word, count, keep = distances(batch.select([1, 2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), *(pa.array(np.round(x, 6), from_pandas=True) for x in (by_class, by_word)), pa.array(keep)],
                ["doc_id", "n_words", "char_distance", "word_distance", "keep"],
            )

    slim = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    return slim.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, char_distance double, word_distance double, keep boolean")


def passing(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    distances = _judge(references(docs, rules, text, lang), rules)
    at = [docs.columns.index(text), docs.columns.index(lang)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, at[0]):
            pair = pa.RecordBatch.from_arrays([batch.column(i) for i in at], ["t", "l"])
            yield batch.filter(pa.array(distances(pair)[3]))

    return docs.mapInArrow(run, docs.schema)
