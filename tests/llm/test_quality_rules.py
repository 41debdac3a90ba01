from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from kavram.llm import quality_rules as Q

from .conftest import prose, words

COMMON = ["the", "of", "and", "to", "in"]


def clean(rng, n):
    return ". ".join(" ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.choice('aeiou')}{rng.randrange(3) * 'l'}" for _ in range(10)).capitalize() for _ in range(n // 10))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = [(i, clean(rng, 200)) for i in range(60)]
    rows += [(100, " ".join(f"{w}***%%%" for w in clean(rng, 200).split()))]  # other characters
    rows += [(101, " | ".join(f"bema{'l' * (i % 3)}" for i in range(300)))]  # other words
    rows += [(102, "*** %%%")]  # too short to judge
    return rows


def brute(rows, rules):
    classes = lambda t: [sum(f(c) for c in t) for f in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: c in "0123456789", lambda c: c in " \t\n\r\f\v", lambda c: c in ".,;:!?'\"()-", lambda c: ord(c) < 128 and not (c.isascii() and c.isalnum()) and c not in " \t\n\r\f\v.,;:!?'\"()-", lambda c: ord(c) > 127)]
    refs = {}
    for _, t, lang in rows:
        r = refs.setdefault(lang or "", [[0] * 7, Counter()])
        r[0] = [a + b for a, b in zip(r[0], classes(t or ""))]
        r[1].update(words(t))

    def js(p, q):
        sp, sq = sum(p) or 1, sum(q)
        p, q = [x / sp for x in p], [x / sq for x in q]
        kl = lambda a: sum(x * math.log2(x / ((y + z) / 2)) for x, y, z in zip(a, p, q) if x > 0)
        return math.sqrt(max(0, min(1, (kl(p) + kl(q)) / 2)))

    out = []
    for i, t, lang in rows:
        ref_classes, counts = refs[lang or ""]
        total = sum(counts.values())
        w = words(t)
        a = b = None
        if total >= rules.min_reference_words:
            common = [x for x, n in counts.items() if n >= rules.common_share * total]
            if len(t or "") >= rules.min_chars:
                a = js(classes(t), ref_classes)
            if len(w) >= rules.min_words:
                own = Counter(w)
                p = [own[x] for x in common]
                q = [counts[x] for x in common]
                b = js([*p, len(w) - sum(p)], [*q, total - sum(q)])
        keep = not (a is not None and a > rules.max_char_distance or b is not None and b > rules.max_word_distance + rules.word_noise / math.sqrt(max(1, len(w))))
        out.append((i, len(w), a and round(a, 5), b and round(b, 5), keep))
    return out


def test_against_brute_force(make, corpus):
    got = Q.judge(make(corpus)).collect()
    want = {r[0]: r for r in brute([(*r, "en") for r in corpus], Q.Rules())}
    assert len(got) == len(corpus)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_words, r.keep) == (w[1], w[4])
        for x, y in ((r.char_distance, w[2]), (r.word_distance, w[3])):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 2e-5)
    assert {r.doc_id for r in got if not r.keep} == {100, 101}


def test_rows_that_pass(make, corpus):
    docs = make(corpus)
    kept = Q.passing(docs)
    assert kept.schema == docs.schema
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if r.doc_id not in (100, 101))


def test_odd_rows(make, odd, corpus):
    docs = make(odd + [(1000 + i, t) for i, t in corpus])
    got = Q.judge(docs)
    assert got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    for i in (3, 4, 5, 6, 10):  # no text, too little text, no reference
        assert all(r.keep and r.word_distance is None for r in by[i])
    assert len(by[1]) == 2 and by[1][0] == by[1][1]
    assert len(by[None]) == 2
    assert Q.judge(make([])).count() == 0 and Q.passing(make([])).count() == 0


def test_parts_give_the_same(make, corpus, monkeypatch):
    docs = make(corpus, parts=1)
    want = sorted(Q.judge(docs).collect())
    assert sorted(Q.judge(docs.repartition(7)).collect()) == want


def test_summaries_keep_every_common_word():
    """Put together in any order, a summary has each word of over 1/(size+1) of all counts."""
    rng = random.Random(3)
    for size in (1, 3, 10):
        parts, total = [], Counter()
        for _ in range(30):
            own = Counter(int(rng.paretovariate(0.6)) % 1000 for _ in range(rng.randrange(1, 400)))
            total += own
            words = np.array(sorted(own), np.uint64)
            parts.append(Q.summary(words, np.array([own[int(w)] for w in words]), size))
        while len(parts) > 1:
            rng.shuffle(parts)
            parts = [Q.summary(*Q._merged(parts[i : i + 4]), size) for i in range(0, len(parts), 4)]
        words = parts[0][0].tolist()
        assert len(words) <= size and {w for w, n in total.items() if n * (size + 1) > sum(total.values())} <= {*words}


def test_candidates_dont_grow_with_the_parts(spark, make):
    """Many small parts of one language, none of which has a common word: the driver gets one summary."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 60, pool=5_000)) for i in range(400)]
    slim = make(rows, 40).selectExpr("text t", "lang l")
    found = Q._tree(slim.mapInArrow(Q._candidates(200), Q._CANDIDATES), 200).collect()
    assert len(found) <= 200
