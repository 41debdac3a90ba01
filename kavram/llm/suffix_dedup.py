"""Operator 5, suffix-array dedup: passages of ``length`` words that occur again.

A position of a text is *repeated* if the ``length`` words from it on occur at
another position too, of this text or another. The result is, for every
document, the maximal stretches of words that repeated positions cover.

Suffixes are compared only where they can be equal. The minimizer of a window of
``length`` words is the least hash of the ``gram``-word grams in it; equal windows
have equal minimizers, and neighbouring windows mostly share the place of theirs, so
a text is a few *runs* of windows. Runs are brought together by minimizer. One that is the
only one of its minimizer repeats nothing. Runs of the same words are repeated
whole: they are counted before they are moved, so a passage with any number of
copies is no large group. Only where one minimizer has different runs are their words
fetched, one run of each kind, and a suffix array is made of them: suffixes that follow
one another in it and share ``length`` words are repeated. A minimizer of over ``_HOT``
different runs (a line of a licence in different surroundings) would make too large
an array for one task; its runs' windows are counted by hash instead.

The suffix array is made by linear grouping: suffixes are put in groups by their
first word, then the groups, in descending order, send each member's pointer to
the previous smaller suffix; suffixes that are pointed to are moved behind their
group by the number of pointers, which sorts them by their Lyndon prefixes. A last
ascending scan along the pointers puts each group's suffixes in order. No
group is renamed and sorted again.

Defined results
  * The unit is a distinct (doc_id, text); a row that is repeated repeats its
    passages. Spans are in words, from 0, the end excluded; each is given once.
  * Null and empty texts, and texts of fewer words, have no spans. Null ids stay
    null. Only id and text are read. Empty tables give no rows.
  * Words are compared by 64-bit hashes within a run as a whole, by 31-bit codes
    within the suffix array, and by 128 bits a window where a minimizer is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .near_dedup import _rid
from .storage import removed, written

#: Words of one suffix array, unless one minimizer's runs alone have more.
_ARRAY_WORDS = 50_000
#: Different runs of a minimizer that one suffix array may hold.
_HOT = 4096


@dataclass(frozen=True)
class Settings:
    length: int = 50
    gram: int = 8


def suffix_array(text: list[int]) -> list[int]:
    """Sorted suffixes of text, whose last symbol occurs once and is the least."""
    n = len(text)
    size_of: dict[int, int] = {}
    for c in text:
        size_of[c] = size_of.get(c, 0) + 1
    at, first = 0, {}
    for c in sorted(size_of):
        first[c] = at
        at += size_of[c]
    group = [first[c] for c in text]  # a group's name is where it begins
    members = [0] * n
    place = [0] * n
    size = [0] * n
    for i in range(n):
        g = group[i]
        place[i] = g + size[g]
        members[place[i]] = i
        size[g] += 1
    prev = [-1] * n

    high = n - 1
    while high >= 0:
        low = group[members[high]]
        pointed: dict[int, int] = {}
        for i in sorted(members[low : high + 1]) if high > low else members[low : high + 1]:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_number: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_number.setdefault(k, []).append(p)
            for k in sorted(by_number, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_number[k]:
                    g = group[p]
                    last = g + size[g] - 1
                    other, here = members[last], place[p]
                    members[here], place[other] = other, here
                    members[last], place[p] = p, last
                    size[g] -= 1
                    moved.setdefault(g, []).append(p)
                for g, own in moved.items():
                    start = g + size[g]
                    for p in own:
                        group[p] = start
                    size[start] = len(own)
        high = low - 1

    out = [-1] * n
    placed = [False] * n
    fill = list(range(n))
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            placed[j] = True
            j = prev[j]
    return out


def repeated_positions(runs: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Of each run of word codes, the positions whose length words are at another position of any run too."""
    size = np.array([len(r) for r in runs])
    # every run ends with a symbol of its own, less than any word; the last is the least
    joined = np.empty(size.sum() + len(runs), dtype=np.int64)
    ends = np.cumsum(size + 1) - 1
    begin = ends - size
    for r, a in zip(runs, begin):
        joined[a : a + len(r)] = r
    joined[ends] = -1 - np.arange(len(runs))
    symbols, ranks = np.unique(joined, return_inverse=True)
    order = np.array(suffix_array(ranks.tolist()))
    one, two = order[:-1], order[1:]
    for t in range(length):
        some = (one + t < len(ranks)) & (two + t < len(ranks))
        one, two = one[some], two[some]
        same = ranks[one + t] == ranks[two + t]
        one, two = one[same], two[same]
    hit = np.unique(np.concatenate([one, two]))
    which = np.searchsorted(ends, hit)
    return [hit[which == i] - begin[i] for i in range(len(runs))] if len(runs) < 32 else np.split(hit - begin[which], np.searchsorted(which, np.arange(1, len(runs))))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbouring values, by doubling."""
    out, have = hashes, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs_of(w: K.Words, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimizer, hash of the words) of the runs of a chunk."""
    n = len(w.hashes)
    none = np.zeros(0, np.int64)
    if n < s.length:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        gram = np.zeros(n - s.gram + 1, dtype=np.uint64)
        for j in range(s.gram):
            gram = gram * K._GRAM + w.hashes[j : j + len(gram)]
        gram = K.mix64(gram)
        least = window_minima(gram, s.length - s.gram + 1)
        text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
        inside = text[: len(least)] == text[s.length - 1 :]
        change = np.ones(len(least), dtype=bool)
        # a run ends where its minimizer's first place is left, even if the same gram comes again
        change[1:] = (least[1:] != least[:-1]) | (gram[: len(least) - 1] == least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | ~inside[:-1]
        start = np.flatnonzero(change & inside)
        stop = np.flatnonzero(np.append(change[1:] | ~inside[1:], True) & inside) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w.hashes * K._power_table(K._BASE, n)[:n], out=total[1:])
        end = stop + s.length - 1
        content = K.mix64((total[end] - total[start]) * K._power_table(K._BASE_INV, n)[start] + (stop - start).astype(np.uint64))
    return text[start], start - w.bounds[text[start]], stop - start, least[start].view(np.int64), content.view(np.int64)


def _runs(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 2):
            text, first, windows, minimizer, content = runs_of(K.words(batch.column(2)), s)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(minimizer), pa.array(content), pa.array(first, pa.int32()), pa.array(windows, pa.int32())],
                ["doc_id", "rid", "minimizer", "content", "first", "windows"],
            )

    return run


def _fetched(s: Settings):
    """Rows (rid, text, runs) to (minimizer, rid, doc_id, first, copies, codes): the words of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 2):
            w = K.words(batch.column(2))
            lists = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            minimizer, first, windows, copies = lists.flatten().flatten()
            start = w.bounds[owner] + first.to_numpy()
            size = windows.to_numpy() + s.length - 1
            bounds = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
            codes = (w.hashes[at] >> np.uint64(33)).astype(np.int32)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [minimizer, batch.column(1).take(rows), batch.column(0).take(rows), first, copies, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes))],
                ["minimizer", "rid", "doc_id", "first", "copies", "codes"],
            )

    return run


def _windows(s: Settings):
    """Rows (rid, text, runs) to (h, g, rid, doc_id, start, alone): 128 bits of each window of each run; alone: its run has no copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 2):
            w = K.words(batch.column(2))
            lists = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            _, first, windows, copies = (x.to_numpy() for x in lists.flatten().flatten())
            bounds = np.concatenate([[0], np.cumsum(windows)])
            start = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], windows)
            text = np.repeat(owner, windows)
            with np.errstate(over="ignore"):
                # two sums of the words, each under a mixing of its own
                keys = []
                for seed, words in ((1, w.hashes), (2, K.mix64(w.hashes ^ K._GRAM))):
                    total = np.zeros(len(words) + 1, dtype=np.uint64)
                    np.cumsum(words * K._power_table(K._BASE, len(words))[: len(words)], out=total[1:])
                    at = w.bounds[text] + start
                    keys.append(K.mix64((total[at + s.length] - total[at]) * K._power_table(K._BASE_INV, len(words) + 1)[at] + np.uint64(seed)))
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k.view(np.int64)) for k in keys), batch.column(1).take(rows), batch.column(0).take(rows), pa.array(start.astype(np.int32)), pa.array(np.repeat(copies == 1, windows))],
                ["h", "g", "rid", "doc_id", "start", "alone"],
            )

    return run


def _compared(s: Settings):
    """Runs sorted by minimizer to the spans of their repeated positions; runs with copies are spans already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0

        def flush():
            found = repeated_positions([r[4] for r in held], s.length)
            rid, doc, start, end = [], [], [], []
            for (_, r, d, first, _, copies), own in zip(held, found):
                if copies > 1 or len(own) == 0:
                    continue
                for part in np.split(own, np.flatnonzero(np.diff(own) > s.length) + 1):
                    rid.append(r)
                    doc.append(d)
                    start.append(first + int(part[0]))
                    end.append(first + int(part[-1]) + s.length)
            kind = held_type[0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rid, pa.binary()), pa.array(doc, kind), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["rid", "doc_id", "start", "end"])

        held_type: list = []
        for batch in batches:
            held_type[:] = [batch.column(2).type]
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
            codes, bounds = batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy()
            bounds = bounds - bounds[0]
            for (minimizer, r, d, first, copies), a, b in zip(rows, bounds, bounds[1:]):
                if words > _ARRAY_WORDS and held[-1][0] != minimizer:
                    yield flush()
                    words = 0
                held.append((minimizer, r, d, first, codes[a:b], copies))
                words += int(b - a)
        if held:
            yield flush()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by text and start, those that touch made one."""
    now = None
    for batch in batches:
        out = []
        for rid, doc, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now and now[0] == rid and a <= now[3]:
                now = (rid, doc, now[2], max(now[3], b))
            else:
                if now:
                    out.append(now)
                now = (rid, doc, a, b)
        if out:
            yield _batch(out, batch.column(1).type)
    if now:
        yield _batch([now], batch.column(1).type)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    _, doc, a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "start_word", "end_word"])


def repeats(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word): the stretches that repeated passages cover."""
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), _rid(doc_id, text).alias("rid"), F.col(text).alias("text"))
    runs = slim.mapInArrow(_runs(s), f"doc_id {kind}, rid binary, minimizer long, content long, first int, windows int")
    # runs are counted before they are moved: a passage of any number of copies is a row for each part of the texts.
    # one: the least mark of those of one kind, which chooses one of them (of two with equal marks both, which changes nothing)
    mark = F.xxhash64("rid", "first")
    counts = written(runs.select("minimizer", "content", mark.alias("mark")).groupBy("minimizer", "content").agg(F.count(F.lit(1)).alias("copies"), F.min("mark").alias("one")), "suffix-counts")
    several = counts.groupBy("minimizer").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    kinds = written(counts.join(several, "minimizer", "left").where("copies > 1 or contents > 1").withColumn("contents", F.coalesce("contents", F.lit(1))), "suffix-kinds")
    removed(counts)
    some = runs.join(kinds.withColumnsRenamed({"minimizer": "m", "content": "c"}), (F.col("minimizer") == F.col("m")) & (F.col("content") == F.col("c")))
    chosen = (F.col("contents") > 1) & (F.col("one") == mark)
    some = written(some.select("rid", "doc_id", "minimizer", "first", "windows", "copies", "contents", chosen.alias("chosen")), "suffix-runs")
    removed(kinds)
    whole = some.where("copies > 1").select("rid", "doc_id", F.col("first").alias("start"), (F.col("first") + F.col("windows") + s.length - 1).alias("end"))
    # one row of each text, and one run of each kind: repeats go where they are
    once = slim.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))

    def texts(which: str) -> DataFrame:
        wanted = some.where("chosen").where(which).dropDuplicates(["rid", "first"])
        wanted = wanted.groupBy("rid").agg(F.collect_list(F.struct("minimizer", "first", "windows", "copies")).alias("runs"))
        return once.join(wanted, "rid").select("doc_id", "rid", "text", "runs")

    fetched = texts(f"contents <= {_HOT}").mapInArrow(_fetched(s), f"minimizer long, rid binary, doc_id {kind}, first int, copies long, codes array<int>")
    compared = fetched.repartition("minimizer").sortWithinPartitions("minimizer").mapInArrow(_compared(s), f"rid binary, doc_id {kind}, start int, end int")
    spans = whole.union(compared)
    if some.where(F.col("contents") > _HOT).limit(1).count():
        windows = texts(f"contents > {_HOT}").mapInArrow(_windows(s), f"h long, g long, rid binary, doc_id {kind}, start int, alone boolean")
        again = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
        spans = spans.union(windows.join(again, ["h", "g"]).where("alone").select("rid", "doc_id", "start", (F.col("start") + s.length).alias("end")))
    spans = spans.groupBy("rid", "start").agg(F.first("doc_id").alias("doc_id"), F.max("end").alias("end")).select("rid", "doc_id", "start", "end")
    return spans.repartition("rid").sortWithinPartitions("rid", "start").mapInArrow(_joined, f"doc_id {kind}, start_word long, end_word long")
