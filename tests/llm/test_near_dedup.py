from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from kavram.llm import near_dedup as N

from .conftest import prose, words


def shingles(text, k=3):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(rows, least):
    sets = [(d, shingles(t)) for d, t in rows]
    return {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len(x & y) >= least * len(x | y)}


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, groups=40):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = prose(rng, rng.choice([30, 80, 300]), 5000)
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            rows.append((i, changed(rng, base, rng.choice([0, 0, 1, 2, len(base.split()) // 30]))))
            i += 1
    return rows


def grouped(docs):
    return {(r.doc_id, r.duplicate_of) for r in N.duplicates(docs).collect()}


def roots(rows, least):
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar(rows, least):
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {(d, top(d)) for d, _ in rows if top(d) != d}


def test_recall_against_brute_force(make):
    rows = corpus(1)
    got = grouped(make(rows))
    want = roots(rows, 0.6)
    allowed = roots(rows, 0.3)
    assert len(got & want) >= 0.9 * len(want) > 20
    assert got <= allowed | want and len(got - want) <= 0.1 * len(want)


def test_recall_just_above_the_threshold(make):
    """Pairs whose similarity is 0.52 to 0.6 are found at 0.9."""
    rng = random.Random(11)
    rows, want = [], []
    while len(want) < 150:
        a = prose(rng, 150, 50_000)
        b = changed(rng, a, 17)
        x, y = shingles(a), shingles(b)
        if 0.52 <= len(x & y) / len(x | y) <= 0.6:
            want.append((len(rows) + 1, len(rows)))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert len(grouped(make(rows)) & {*want}) >= 0.9 * len(want)


def test_chunks_of_a_bucket_give_the_same(make, monkeypatch):
    """One hot bucket, searched at once and by pairs of chunks."""
    rng = random.Random(12)
    base = prose(rng, 120, 5000)
    rows = [(i, changed(rng, base, rng.randrange(1, 9))) for i in range(160)] + [(1000 + i, prose(rng, 60, 5000)) for i in range(20)]
    want = grouped(make(rows))
    assert len(want) > 100
    for size in (2, 16):
        monkeypatch.setattr(N, "_BUCKET", size)
        assert grouped(make(rows)) == want


def test_estimate():
    """Near the true similarity, whatever bits are left out."""
    rng = np.random.default_rng(3)
    for bits in (1, 2, 4, 8):
        errors = []
        for true in (0.2, 0.5, 0.8, 1.0):
            both = rng.integers(0, 2**63, 4000, dtype=np.uint64)
            n = int(4000 * true)
            other = np.concatenate([both[:n], rng.integers(0, 2**63, 4000 - n, dtype=np.uint64)])
            real = n / (8000 - n)
            sigs = [N.packed(N.minima(x, np.array([0, len(x)]), 1024), bits)[0] for x in (both, other)]
            errors.append(abs(N.similarity(sigs[0], sigs[1][None], 1024, bits)[0] - real))
        assert max(errors) < 0.12 and errors[-1] == 0


def test_rows_that_stay(make, odd):
    rows = corpus(2)
    docs = make(rows)
    kept = N.deduplicated(docs)
    gone = {a for a, _ in grouped(docs)}
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in gone)


def test_odd_rows(make, odd):
    docs = make(odd)
    assert grouped(docs) == {(2, 1), (None, 1)}
    kept = N.deduplicated(docs)
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    want = [(1, odd[0][1]), *((d, t) for d, t, *_ in odd[4:])]
    assert got == sorted(want, key=str)
    assert N.deduplicated(make([])).count() == 0 and grouped(make([])) == set()


def test_ids_used_twice(make):
    """Two texts under one id are two documents; a null id never goes before one that isn't."""
    rng = random.Random(3)
    a, b = prose(rng, 50), prose(rng, 50, 9000)
    docs = make([(1, a), (1, b), (2, a), (None, b), (None, a)])
    assert sorted((r.doc_id, r.text) for r in N.deduplicated(docs).collect()) == sorted([(1, a), (1, b)])


def test_large_groups(make):
    rng = random.Random(4)
    base = prose(rng, 200, 5000)
    rows = [(i, changed(rng, base, 2)) for i in range(1200)] + [(5000 + i, base) for i in range(300)]
    rows += [(9000 + i, prose(rng, 200, 5000)) for i in range(50)]
    assert grouped(make(rows)) == {(d, 0) for d, _ in rows[1:1500]}


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_bucket(seed):
    """The same groups as from all pairs, with a tree of links."""
    rng = np.random.default_rng(seed)
    s = N.Settings()
    base = rng.integers(0, 256, (4, s.bits, s.perms // 8), dtype=np.uint8)
    sigs = base[rng.integers(0, 4, 60)]
    flips = rng.random(sigs.shape) < 0.03
    sigs = np.where(flips, rng.integers(0, 256, sigs.shape, dtype=np.uint8), sigs)
    ids = np.arange(60)
    parent = list(range(60))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(60), 2):
        if N.similarity(sigs[a], sigs[b][None], s.perms, s.bits)[0] >= s.threshold:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    want = [top(x) for x in range(60)]
    links = N._links_of_bucket(ids, sigs, s)
    parent = list(range(60))
    for a, b, _ in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(x) for x in range(60)] == want and len(links) == 60 - len(set(want))


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    mess = [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(40)]
    links = [*chain, *star, *mess]
    parent: dict[int, int] = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    links += [(3000 + i, 3000 + (i * 7 + 1) % 997) for i in range(997) if i != (i * 7 + 1) % 997]  # long rings
    for a, b in links[-996:]:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.id: r.root for r in N.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert N.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
