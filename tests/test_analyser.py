"""The analyser leaves out only what can't become a reading."""

from __future__ import annotations

import random

from kavram.operators import morphology as M

WORDS = "ban'a BANA ΑΣ'ta ΟΔΟΣ ΑΣ kitab'ı hakkı HAKKI gidiyor Gidiyor İSTANBUL'a İİİ ışık a ' '' ς 12'de 12 3,5 ...'da ağacı Ağaca burnu".split()


def _dictionaries(rng: random.Random, words: list[str]) -> M.Dictionaries:
    ends = [M.lower(w[rng.randrange(len(w)) :]) for w in words] + ["'da", "a", "ı", "σ", "σ'ta"]
    tags = ["Noun+A3sg", "Noun+Prop+A3sg", "Verb+Pos^DB+Adj", "Num+Card", "Adj"]
    return M.Dictionaries({e: rng.sample(tags, 2) for e in ends if e} | {"null": tags}, {M.lower(w[: rng.randrange(1, len(w) + 1)]): rng.sample(["Noun", "Verb", "Adj", "Noun+Prop"], 2) for w in words} | {"Ban": ["Noun+Prop"], "αs": ["Noun"]})


def test_same_readings_as_of_all_splits(monkeypatch):
    rng = random.Random(1)
    words = WORDS + ["".join(rng.choice("abcçdeğıiİIkKtTyoruΣσ'1") for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    several = 0
    for _ in range(3):
        d = _dictionaries(rng, rng.sample(words, 60) + WORDS)
        got = [M.analyses(w, d) for w in words]
        every = M.splits
        with monkeypatch.context() as m:
            m.setattr(M, "splits", lambda word, known=None: every(word))
            assert got == [M.analyses(w, d) for w in words]
        several += sum(len(x) > 1 for x in got)
    assert several > 100


def test_few_splits_are_looked_at(monkeypatch):
    """Their number follows the suffixes, not the length of the word."""
    seen, expanded = [], M._expanded
    monkeypatch.setattr(M, "_expanded", lambda stem, suffix: seen.append(suffix) or expanded(stem, suffix))
    d = M.Dictionaries({"lar": ["Noun+A3pl"], "null": ["Noun+A3sg"]}, {"kitap": ["Noun"]})
    assert M.analyses("kitaplar", d) == [("kitap", "lar", ["Noun", "A3pl"])]
    assert seen == ["plar", "lar", "r"]
    seen.clear()
    M.analyses("x" * 500, d)
    assert len(seen) <= 2


def test_tokens_are_analysed_once_without_a_join(spark, small):
    from kavram.plans import queries as Q

    plan = Q.QUERIES["morph_candidates"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_candidates_as_analysed(spark):
    d = M.Dictionaries({"lar": ["Noun+A3pl", "Verb+A3pl"], "null": ["Noun+A3sg"]}, {"kitap": ["Noun", "Verb"]})
    words = ["kitaplar", "kitap", "", "x"]
    got = {r.token: r.candidates for r in M.candidates(spark.createDataFrame([(w,) for w in [*words, None, "x"]], "token string"), d).collect()}
    assert got.pop(None) is None
    assert {w: [(x.root, x.suffix, x.tags) for x in c] for w, c in got.items()} == {w: M.analyses(w, d) for w in words}
