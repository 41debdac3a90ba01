from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kavram.llm import packing as P

from .conftest import prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(0, 40))
def test_tree(capacities, n):
    tree = P.CapacityTree(40)
    for c in capacities:
        tree.add(c)
    assert tree.least(n) == min((c for c in capacities if c >= n), default=-1)
    for c in capacities[::2]:
        tree.add(c, -1)
    assert tree.least(n) == min((c for c in capacities[1::2] if c >= n), default=-1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_best_fit_decreasing(sizes):
    rows = P.best_fit_decreasing(np.array(sizes, dtype=np.int64), 30)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    want: list[int] = []  # free space, by plain search
    for n in sorted(sizes, reverse=True):
        fit = [c for c in want if c >= n]
        if fit:
            want[want.index(min(fit))] -= n
        else:
            want.append(30 - n)
    assert sorted(30 - sum(sizes[i] for i in r) for r in rows) == sorted(want)


def check(docs, s):
    rows = P.packed(docs, s).collect()
    width = P.token_type(s)
    for r in rows:
        ids, places = np.frombuffer(r.ids, width), np.frombuffer(r.position_ids, width)
        assert len(ids) == len(places) == s.length
        cu = r.cu_seqlens
        assert cu[0] == 0 and cu[-1] == r.n_tokens and cu == sorted(set(cu))
        assert len(cu) - 1 == len(r.doc_ids) == len(r.doc_offsets) == len(r.doc_rows)
        for a, b in zip(cu, cu[1:]):
            assert np.array_equal(places[a:b], np.arange(b - a))
        assert (ids[r.n_tokens :] == s.pad).all() and not places[r.n_tokens :].any()
    want = Counter((d.doc_id, d.text or "") for d in docs.collect())
    assert Counter(P.decode(rows, s)) == want
    assert len({(r.pool, r.row) for r in rows}) == len(rows)
    return rows


@pytest.mark.parametrize("length", [16, 100, 2048])
def test_round_trip(make, odd, length):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 60, 900]))) for i in range(60)]
    check(make(rows), P.Settings(length=length))
    check(make(odd), P.Settings(length=length, pool_tokens=1000))
    check(make(rows, parts=1), P.Settings(length=length, pool_tokens=500))


def plainly(sizes, length):
    """Best fit decreasing by looking at every row; of equal ones the one that got its space last."""
    rows, space, since = [], [], []
    for turn, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        fits = [r for r in range(len(rows)) if space[r] >= sizes[i]]
        if fits and sizes[i] < length:
            r = min(fits, key=lambda r: (space[r], -since[r]))
        else:
            r = len(rows)
            rows.append([])
            space.append(length)
            since.append(turn)
        rows[r].append(i)
        space[r] -= sizes[i]
        since[r] = turn
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_query_against_brute_force(make, odd, parts):
    """Every pool's whole rows, from the texts: pieces, their order and their ids."""
    rng = random.Random(11)
    s = P.Settings(length=64, pool_tokens=3000)
    encode = P.encoding(s.ranks).encode_ordinary
    rows = [(i, prose(rng, rng.choice([0, 1, 7, 7, 30, 200]))) for i in range(150)] + odd[:10]
    got = P.packed(make(rows, parts), s).collect()
    assert len({r.pool for r in got}) >= parts
    width, text_of = P.token_type(s), {}
    for key, text in P.decode(got, s):
        text_of.setdefault(key, []).append(text)
    pools = {}
    for r in got:
        pools.setdefault(r.pool, []).append(r)
    for own in pools.values():
        own.sort(key=lambda r: r.row)
        docs = {}
        for r in own:
            ids = np.frombuffer(r.ids, width)
            for a, b, d, at in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_rows, r.doc_offsets):
                docs.setdefault(d, {})[at] = ids[a:b].tolist()
        assert sorted(docs) == list(range(len(docs)))
        pieces = []
        for d in range(len(docs)):
            tokens = [t for at in sorted(docs[d]) for t in docs[d][at]]
            assert tokens[-1] == s.end and tokens[:-1] == encode(P.encoding(s.ranks).decode(tokens[:-1]))
            pieces += [(d, at, len(tokens[at : at + s.length])) for at in range(0, len(tokens), s.length)]
        want = [[pieces[i][:2] for i in row] for row in plainly([n for *_, n in pieces], s.length)]
        assert [list(zip(r.doc_rows, r.doc_offsets)) for r in own] == want


def test_special_strings_are_text(make):
    check(make([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")]), P.Settings(length=8))


def test_rows_are_full(make):
    """Nearly all space is used where pieces of many lengths are at hand."""
    rng = random.Random(2)
    rows = check(make([(i, prose(rng, rng.randrange(1, 60))) for i in range(600)], parts=1), P.Settings(length=512))
    assert sum(r.n_tokens for r in rows) > 0.97 * 512 * len(rows)


def test_wide_ids(make):
    s = P.Settings(length=70_000)
    assert P.token_type(s) == np.dtype("<u4")
    check(make([(1, "a b"), (2, prose(random.Random(3), 40_000))], parts=1), s)


def test_empty(make):
    assert P.packed(make([])).count() == 0
