from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st

from kavram.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.tuples(st.floats(0.1, 10), st.integers(0, 40)), min_size=1, max_size=12))
def test_schedule(sources):
    """Against the weights as they were given, not as they are rounded."""
    part = M.parts({k: w for k, (w, _) in sources.items()})
    blocks = {k: n for k, (_, n) in sources.items()}
    slots = M.schedule(part, {k: min(n, 1 + int(3000 * part[k] / sum(part.values()))) for k, n in blocks.items()})
    end = sum(map(len, slots.values()))
    assert sorted(t for own in slots.values() for t in own) == list(range(end))
    total = sum(Fraction(w) for w, _ in sources.values())
    for k, own in slots.items():
        w = Fraction(part[k], sum(part.values()))
        for j, t in enumerate(own):  # within release and deadline
            assert j / w - 1 < t < -(-(j + 1) // w)
        exact, got, mine = Fraction(sources[k][0]) / total, 0, {*own}
        for t in range(end + 1):  # less than a block off, at any time
            assert abs(got - w * t) < 1 and abs(got - exact * t) < 1.001
            got += t in mine


def test_skewed_sources_keep_their_weights():
    """One source of ten million documents and fifty of two hundred."""
    counts = {f"s{k}": 200 for k in range(50)} | {"hot": 10_000_000}
    block, plan = M._plan(counts, M.Settings(), None)
    end = sum(len(own) for _, _, own in plan)
    total = sum(n**0.7 for n in counts.values())
    assert block == 10 and end <= 1.01 * M.Settings().max_slots
    for k, n, own in plan:
        assert abs(len(own) - n**0.7 / total * end) < 1.001


def brute(rows, s, weights=None):
    by: dict = {}
    for d, source in rows:
        by.setdefault(source, []).append(d)
    for own in by.values():
        own.sort(key=lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest())
    weights = weights or {k: len(v) ** s.temperature for k, v in by.items()}
    weights = {k: w for k, w in weights.items() if k in by and w > 0}
    part = M.parts(weights)
    total = sum(part.values())
    block = max(s.block_docs, math.ceil(max(Fraction(len(by[k]) * total, part[k]) for k in part) / s.max_slots))
    given, out, slot, left = Counter(), [], 0, {k: len(by[k]) for k in weights}
    while any(n > 0 for n in left.values()):
        blocks = {k: given[k] // block for k in part}
        ready = [k for k in part if blocks[k] * total // part[k] <= slot]
        k = min(ready, key=lambda k: (math.ceil(Fraction((blocks[k] + 1) * total, part[k])), k is None, str(k)))
        for _ in range(block):
            e = given[k]
            out.append((by[k][e % len(by[k])], k, slot, e // block, e // len(by[k])))
            given[k] += 1
        left[k] -= block
        slot += 1
    return out


def rows(rng, sizes):
    return [(rng.randrange(10**6), k) for k, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 40, None: 7, "c": 1}, {"a": 5}, {"a": 64, "b": 64}])
def test_against_brute_force(make, sizes):
    s = M.Settings()
    data = rows(random.Random(4), sizes)
    got = M.mixed(make([(d, "x", "en", k) for d, k in data]), s).select("doc_id", "source", "slot_", "block", "epoch_")
    assert Counter(map(tuple, got.collect())) == Counter(brute(data, s))


def test_given_weights(make):
    s = M.Settings(max_slots=12)
    data = rows(random.Random(6), {"a": 90, "b": 90, "c": 90})
    weights = {"a": 3, "b": 1, "absent": 5, "c": 0}
    got = M.mixed(make([(d, "x", "en", k) for d, k in data]), s, weights).select("doc_id", "source", "slot_", "block", "epoch_")
    assert Counter(map(tuple, got.collect())) == Counter(brute(data, s, weights))
    assert {r.source for r in got.collect()} == {"a", "b"}


def test_many_buckets_give_the_same(make, monkeypatch):
    data = rows(random.Random(8), {"a": 400, "b": 30})
    docs = make([(d, "x", "en", k) for d, k in data])
    want = Counter(map(tuple, M.mixed(docs).collect()))
    monkeypatch.setattr(M, "_BUCKET_ROWS", 2)
    assert Counter(map(tuple, M.mixed(docs).collect())) == want


def test_many_epochs_give_the_same(make, monkeypatch):
    """A source of one document that is repeated hundreds of times, made in ranges and at once."""
    data = rows(random.Random(8), {"a": 600, "b": 1})
    docs = make([(d, "x", "en", k) for d, k in data])
    weights = {"a": 1, "b": 2}
    want = Counter(map(tuple, M.mixed(docs, weights=weights).collect()))
    assert sum(n for r, n in want.items() if "b" in r) > 1000
    for size, sources in ((7, 0), (1, 1)):
        monkeypatch.setattr(M, "_EPOCHS", size)
        monkeypatch.setattr(M, "_BROADCAST_SOURCES", sources)
        assert Counter(map(tuple, M.mixed(docs, weights=weights).collect())) == want


def test_odd_rows(make, odd):
    docs = make(odd)
    got = M.mixed(docs)
    assert got.columns == [*docs.columns, "slot_", "block", "epoch_"]
    every = Counter(map(tuple, got.select(docs.columns).collect()))
    assert set(every) == set(map(tuple, docs.collect()))  # nothing is lost
    first = Counter(map(tuple, got.where("epoch_ = 0").select(docs.columns).collect()))
    assert first == Counter(map(tuple, docs.collect()))
    assert M.mixed(make([])).count() == 0 and M.in_order(make([])).count() == 0


def test_maps_and_other_columns(spark):
    docs = spark.sql("select cast(id as long) doc_id, 'a' source, map(id, 'x') m, array(id) l, id % 2 slot from range(5)")
    assert M.mixed(docs).count() == 8 * 1


def test_order_of_rows(make):
    data = rows(random.Random(4), {"a": 300, "b": 40})
    docs = make([(d, "x", "en", k) for d, k in data])
    slots = {(r.doc_id, r.source): r.slot_ for r in M.mixed(docs).where("epoch_ = 0").collect()}
    out = M.in_order(docs)
    assert out.schema == docs.schema
    seen, order = set(), []
    for r in out.collect():
        if (r.doc_id, r.source) not in seen:
            seen.add((r.doc_id, r.source))
            order.append(slots[r.doc_id, r.source])
    assert order == sorted(order)
