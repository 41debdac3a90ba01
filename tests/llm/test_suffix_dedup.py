from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from kavram.llm import suffix_dedup as S

from .conftest import prose, words


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(text):
    text = [*text, 0]
    assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_regular_texts():
    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 2000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for t in ("a" * 500, "ab" * 250, fibonacci[1], "".join("abc"[bin(i).count("1") % 3] for i in range(1000))):
        text = [*map(ord, t), 0]
        assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=40), st.integers(1, 6))
def test_repeated_positions(runs, length):
    every = Counter(tuple(r[i : i + length]) for r in runs for i in range(len(r) - length + 1))
    want = [[i for i in range(len(r) - length + 1) if every[tuple(r[i : i + length])] > 1] for r in runs]
    got = S.repeated_positions([np.array(r, np.int32) for r in runs], length)
    assert [x.tolist() for x in got] == want


def brute(rows, length):
    texts = [(d, words(t)) for d, t in rows]
    every = Counter(tuple(w[i : i + length]) for _, w in texts for i in range(len(w) - length + 1))
    out = set()
    for d, w in texts:
        cur = None
        for i in range(len(w) - length + 1):
            if every[tuple(w[i : i + length])] > 1:
                if cur and i <= cur[1]:
                    cur = (cur[0], i + length)
                else:
                    if cur:
                        out.add((d, *cur))
                    cur = (i, i + length)
        if cur:
            out.add((d, *cur))
    return sorted(out, key=str)


def found(docs, s=S.Settings()):
    return sorted(map(tuple, S.repeats(docs, s).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n, 3000) for n in (49, 50, 51, 60, 120, 400)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 200), 3000)]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts += [p, prose(rng, rng.randrange(0, 60), 3000)]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, " ".join(rows[4][1].split()[:-1]))]
    rows += [(103, "et " * 300), (104, "a b c " * 60), (105, passages[4] + " " + passages[4]), (106, prose(rng, 70, 3000))]
    changed = rows[5][1].split()
    for at in range(20, len(changed), 90):
        changed[at] = "new"
    return rows + [(107, " ".join(changed))]


def test_against_brute_force(make):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(make(rows)) == brute(rows, 50)


def test_other_lengths_and_small_arrays(make, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(S, "_ARRAY_WORDS", 100)
    assert found(make(rows)) == brute(rows, 50)
    assert found(make(rows), S.Settings(length=20, gram=5)) == brute(rows, 20)
    assert found(make(rows), S.Settings(length=9, gram=8)) == brute(rows, 9)


def test_a_hot_minimizer(make, monkeypatch):
    """A line of 40 words in surroundings that differ, and that are the same at times; by array and by windows."""
    rng = random.Random(9)
    line = prose(rng, 40, 10**6)
    around = [prose(rng, 30, 10**6) for _ in range(12)]
    rows = [(i, f"{prose(rng, 20, 10**6)} {rng.choice(around)} {line} {rng.choice(around)} {prose(rng, 20, 10**6)}") for i in range(120)]
    rows += [(i, f"{prose(rng, 60, 10**6)} {line} {prose(rng, 60, 10**6)}") for i in range(200, 300)] + rows[:3]
    want = brute(rows, 50)
    assert found(make(rows)) == want
    monkeypatch.setattr(S, "_HOT", 3)
    assert found(make(rows)) == want


def test_odd_rows(make, odd):
    got = found(make(odd))
    assert got == brute([r[:2] for r in odd], 50)
    assert (None, 0, 120) in got and (1, 0, 120) in got
    assert found(make([])) == []


def test_a_passage_in_very_many_documents(make):
    rng = random.Random(7)
    passage = prose(rng, 80, 10**6)
    rows = [(i, f"{prose(rng, 20, 10**6)} {passage} {prose(rng, 20, 10**6)}") for i in range(1500)]
    assert found(make(rows)) == brute(rows, 50)
