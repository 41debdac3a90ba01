from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from kavram.llm import quality_crf as C

LABELS = "doc_id long, quality int, text string"


def line(rng, bad):
    w = [f"{rng.choice('bdglmt')}{rng.choice('aeio')}{rng.choice('nrs')}" for _ in range(rng.randrange(5, 15))]
    return rng.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x + "***" for x in w)]) if bad else " ".join(w).capitalize() + "."


def corpus(seed, n=160):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        own = [line(rng, bad and j > 0) for j in range(rng.randrange(2, 12))]
        rows.append((i, "\n".join(own)))
        if i % 2 == 0 or bad:
            labels.append((i, int(not bad), None))
    return rows, labels


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 4, 4, 5, 8])
    score, move = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = C.marginals(score, move, C.Chains(bounds))
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        total, one, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] for i, v in enumerate(y) if v) + sum(move[y[i], y[i + 1]] for i in range(len(y) - 1)))
            total += w
            one += w * np.array(y)
            for i in range(len(y) - 1):
                two[y[i], y[i + 1]] += w
        want[a:b] = one / total
        want_pairs += two / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_lines():
    measures, length, bounds = C.lines(pa.array(["Ab é.\n\nxx xx\nxx xx", None, "", "\n", "|||"]))
    assert bounds.tolist() == [0, 3, 3, 3, 3, 4] and length.tolist() == [5, 5, 5, 3]
    assert measures.shape == (4, C.MEASURES)
    assert measures[:, -3].tolist() == [0, 0, 1, 0]  # the repeated line
    assert measures[:, -2].tolist() == [1, 0, 0, 0] and measures[:, -1].tolist() == [1, 0, 0, 0]
    x = C.with_neighbours(measures, bounds)
    assert np.array_equal(x[1, 1 + C.MEASURES : 1 + 2 * C.MEASURES], measures[0]) and not x[3, 1 + C.MEASURES : -2].any()


def test_held_out_accuracy(spark, make):
    rows, labels = corpus(1, 240)
    got = {r.doc_id: r for r in C.judged(make(rows), spark.createDataFrame(labels, LABELS)).collect()}
    held_out = [i for i, _ in rows if not any(i == x for x, _, _ in labels)]
    unseen, _ = corpus(2, 100)
    field = C.trained(make(rows), spark.createDataFrame(labels, LABELS))
    right = [got[i].keep for i in held_out]
    right += [(C.qualities(pa.array([t]), field)[2][0] < 0.5) == (i % 4 == 0) for i, t in unseen]
    assert np.mean(right) >= 0.95
    # the first line of a bad document is good
    bad = [got[i] for i, _ in rows if i % 4 == 0]
    assert np.mean([r.n_bad_lines == r.n_lines - 1 for r in bad]) > 0.8


def test_odd_rows(spark, make, odd):
    rows, labels = corpus(3)
    labels += [(None, 0, None), (2, None, None), (0, 1, None), (0, 0, None), (8, 0, None), (8, 0, None), (10**9, 0, None)]
    docs = make(rows + [(1000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd])
    got = C.judged(docs, spark.createDataFrame(labels, LABELS))
    assert got.count() == docs.count()
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    for i in (1003, 1004):
        assert all(r.quality is None and r.keep and r.n_lines == 0 for r in by[i])
    assert len(by[1001]) == 2 and by[1001][0] == by[1001][1] and len(by[None]) == 2


def test_without_labels(spark, make):
    rows, labels = corpus(4, 20)
    for some in ([], [x for x in labels if x[1] == 1]):
        got = C.judged(make(rows), spark.createDataFrame(some, LABELS)).collect()
        assert len(got) == 20 and all(r.keep and r.quality is None for r in got)
    assert C.judged(make([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_in_any_company(spark, make):
    """A document's quality doesn't depend on those it is computed with."""
    rows, labels = corpus(5)
    field = C.trained(make(rows), spark.createDataFrame(labels, LABELS))
    texts = [t for _, t in rows]
    together = C.qualities(pa.array(texts), field)[2]
    assert np.allclose(together, [C.qualities(pa.array([t]), field)[2][0] for t in texts])
