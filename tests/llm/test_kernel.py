from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from kavram.llm import kernel as K

from .conftest import words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\n.ß日| ", max_size=30)), max_size=8))
def test_words(texts):
    w = K.words(pa.array(texts, pa.string()))
    assert [w.text(a, b) for a, b in zip(w.bounds, w.bounds[1:])] == [words(t) for t in texts]
    by: dict[str, set] = {}
    for (a, b), t in zip(zip(w.bounds, w.bounds[1:]), texts):
        for h, x in zip(w.hashes[a:b], words(t)):
            by.setdefault(x, set()).add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=7), max_size=6), st.integers(1, 4))
def test_grams(texts, k):
    w = K.words(pa.array([" ".join(t) for t in texts], pa.string()))
    hashes, bounds = K.grams(w.hashes, w.bounds, k)
    seen: dict[tuple, int] = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        own = [tuple(t[i : i + k]) for i in range(len(t) - k + 1)] if len(t) >= k else [tuple(t)] * bool(t)
        assert len(own) == b - a
        for g, h in zip(own, hashes[a:b]):
            assert seen.setdefault(g, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_long_text_and_slices():
    rng = random.Random(1)
    text = " ".join(f"v{rng.randrange(1000)}" for _ in range(400_000))
    array = pa.array(["skipped", text, "a b"]).slice(1)
    w = K.words(array)
    assert list(np.diff(w.bounds)) == [400_000, 2]
    assert w.hashes[0] == K.words(pa.array([text.split()[0]])).hashes[0]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, text, "b", ""])], ["t"])
    parts = list(K.byte_chunks([batch], 0, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == ["a", None, text, "b", ""]


def test_bytes_that_are_no_text():
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 3, 5], np.int32)), pa.py_buffer(b"a\xff b ")])
    assert len(K.words(bad).hashes) >= 2
