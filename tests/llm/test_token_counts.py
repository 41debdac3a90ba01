from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from kavram.llm import token_counts as C

from .conftest import prose

MODEL = C.Settings().model


def brute(text, vocab):
    """Tokens by trying every segmentation of every pre-token from the front."""
    total = 0
    for w in "".join(" " if c in " \t\n\r\f\v" else c for c in text or "").split(" "):
        if not w:
            continue
        raw = (C.MARK + w).encode()
        best = {0: (0, 0)}
        for a in range(len(raw)):
            for b in range(a + 1, min(len(raw), a + vocab.longest) + 1):
                value = vocab.values.get(raw[a:b])
                options = [] if value is None else [value]
                options += [vocab.byte] if b == a + 1 else []
                for v in options:
                    if b not in best or best[a][0] + v > best[b][0]:
                        best[b] = (best[a][0] + v, best[a][1] + 1)
        total += best[len(raw)][1]
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcdé ▁日\n", max_size=40)), max_size=8))
def test_small_vocabulary(texts):
    vocab = C.Vocabulary(["▁", "a", "b", "ab", "▁a", "bc", "abc", "c", "é", "▁ab", "cab", "ca"])
    assert C.tokens_of(pa.array(texts, pa.string()), vocab).tolist() == [brute(t, vocab) for t in texts]


def test_public_vocabulary():
    rng = random.Random(1)
    vocab = C.vocabulary(MODEL)
    texts = [" ".join("".join(rng.choice("theranionédsß-.,'") for _ in range(rng.randrange(1, 14))) for _ in range(80)) for _ in range(20)]
    texts += ["x" * 500 + " y", "日本語 \U0001f600 ok", "the\tcat\nsat\x0bdown"]
    assert C.tokens_of(pa.array(texts), vocab).tolist() == [brute(t, vocab) for t in texts]


def test_nodes_are_shared(monkeypatch):
    """Scores are computed once for each distinct prefix."""
    vocab = C.vocabulary(MODEL)
    seen = 0
    plain = C.Vocabulary.look_up

    def counted(self, hashes):
        nonlocal seen
        seen += len(hashes)
        return plain(self, hashes)

    monkeypatch.setattr(C.Vocabulary, "look_up", counted)
    text = " ".join("common" + x for x in ("a", "b", "ab", "abc", "abd"))
    words = [C.MARK + w for w in text.split()]
    for wide, nodes in (
        (1, {w.encode()[: i + 1] for w in words for i in range(len(w.encode()))}),  # by byte
        (10**9, {w[: i + 1] for w in words for i in range(len(w))}),  # by character
    ):
        monkeypatch.setattr(C, "_WIDE", wide)
        seen = 0
        C.tokens_of(pa.array([text] * 50), vocab)
        assert seen == sum(min(len(n), vocab.longest) for n in nodes)


def test_table(make, odd):
    rng = random.Random(2)
    rows = odd + [(100 + i, prose(rng, 50)) for i in range(30)]
    docs = make(rows)
    vocab = C.vocabulary(MODEL)
    short = [r for r in rows if len(r[1] or "") < 50_000]
    got = sorted([tuple(r) for r in C.counted(docs, C.Settings(chunk_bytes=2000)).collect()], key=str)
    want = [(r[0], brute(r[1], vocab)) for r in short]
    assert len(got) == len(rows)
    rest = list(got)
    for x in want:
        rest.remove(x)
    assert len(rest) == 2 and all(n > 10_000 for _, n in rest)
    assert {r[0]: r[1] for r in got}[3] == 0
    assert C.counted(make([])).count() == 0


def test_long_pretokens(monkeypatch):
    """Levels and branches give the same, whatever part of the trie each does; text without spaces too."""
    rng = random.Random(4)
    vocab = C.vocabulary(MODEL)
    han = "".join(rng.choice("的一是不了人我在有他这中大来上国日本語東京ヶ🙂éa") for _ in range(700))
    texts = [han, han[:300] + "x" + han[300:], han[:299] + "語", han[:40], "internationalisation " * 3 + "aé" * 200, "aé" * 199 + "b", "x" * 2000, "", None]
    texts += ["".join(rng.choice("theran") for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    want = [brute(t, vocab) for t in texts]
    for wide, segment in ((512, 1 << 16), (1, 1 << 16), (10**9, 1 << 16), (10**9, 3), (8, 100)):
        monkeypatch.setattr(C, "_WIDE", wide)
        monkeypatch.setattr(C, "_SEGMENT", segment)
        assert C.tokens_of(pa.array(texts, pa.string()), vocab).tolist() == want, (wide, segment)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdé ▁日", max_size=60), max_size=12))
def test_branches_of_a_small_vocabulary(texts):
    vocab = C.Vocabulary(["▁", "a", "b", "ab", "▁a", "bc", "abc", "c", "é", "▁ab", "cab", "ca", "日", "日a"])
    wide = C._WIDE
    try:
        for C._WIDE in (1, 3, 10**9):
            assert C.tokens_of(pa.array(texts, pa.string()), vocab).tolist() == [brute(t, vocab) for t in texts]
    finally:
        C._WIDE = wide


def test_text_without_spaces_takes_no_longer():
    """Scored by branches, its time by byte stays near that of spaced text."""
    rng = random.Random(5)
    vocab = C.vocabulary(MODEL)
    spaced = " ".join("".join(rng.choice("theranioneds") for _ in range(rng.randrange(1, 12))) for _ in range(150_000))
    han = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(len(spaced) // 3))
    taken = []
    for text in (spaced, han):
        C.tokens_of(pa.array([text[:1000]]), vocab)
        began = time.process_time()
        C.tokens_of(pa.array([text]), vocab)
        taken.append(time.process_time() - began)
    assert taken[1] < 4 * taken[0]
    print(taken)
