"""Models in blocks of lists, against a loop over every token's own window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from kavram.models import networks as N, serve, taggers as M
from kavram.operators import morphology as Y

WINDOW = 5


@pytest.mark.parametrize("layers", [1, 2, 3])
@pytest.mark.parametrize("backwards", [False, True])
def test_contexts_like_whole_windows(layers, backwards):
    rng = np.random.default_rng(layers)
    stack = N.Stack(N.Weights(None, 3), 4, 6, layers, backwards)
    kinds = rng.standard_normal((9, 4)).astype(np.float32)
    numbers = rng.integers(1, 9, (12, 3))
    first = stack.layers[0]
    got = N.Contexts(stack.layers, first.columns(kinds[:1].T), WINDOW, backwards).run(first.columns(kinds.T), numbers)
    for t in range(12):
        own = [N.padded(numbers[:t, i].tolist(), WINDOW) for i in range(3)]
        rows = np.array([x[::-1] if backwards else x for x in own])
        assert np.allclose(got[:, t].T, stack.run(kinds[rows]), atol=1e-5), t


@pytest.fixture
def lively(monkeypatch):
    """Small blocks, and random weights under which results differ from token to token: biases don't outweigh inputs."""
    take = N.Weights.take

    def scaled(self, *shape):
        w = take(self, *shape)
        w *= 0.1 if len(shape) == 1 or shape[0] == 2 else 2
        return w

    monkeypatch.setattr(N.Weights, "take", scaled)
    monkeypatch.setattr(M, "_CELLS", 64)
    monkeypatch.setattr(M, "_LEAST", 16)


def _lists(seed: int, words: list[str], sizes: tuple[int, ...] = (0, 1, 3, 14, 7, 1, 20)) -> list[list[str]]:
    rng = np.random.default_rng(seed)
    return [[words[k] for k in rng.integers(0, len(words), n)] for n in sizes]


def _context_loop(net: M.ContextNet, x: list[str], pieces, decide) -> list[tuple]:
    """The sentence alone, each token with the whole of its windows."""
    s, done, rows = net.size, [], []
    vector = lambda ids: net.word.run(net.embedding[np.array([ids]) % s.vocabulary])[0]
    none, own = vector([0] * s.pieces), [vector(N.padded(pieces(w), s.pieces)) for w in x]
    for t, now in enumerate(own):
        left = own[max(0, t - s.window) : t]
        right = own[t + 1 : t + 1 + s.window]
        past = rows[max(0, t - s.window) : t]
        empty = np.zeros(len(net.history.layers[0].kernel), np.float32)
        parts = [
            now,
            net.left.run(np.array([[none] * (s.window - len(left)) + left]))[0],
            net.right.run(np.array([right + [none] * (s.window - len(right))]))[0],
            net.history.run(np.array([[empty] * (s.window - len(past)) + past]))[0],
        ]
        decision = decide(net.out.run(net.two.run(net.one.run(np.concatenate(parts)[None]))))
        done.append(tuple(int(d[0]) for d in decision))
        row = np.zeros_like(empty)
        for at, d in zip((0, s.window + 1), done[-1]):
            row[at + d] += 1
        rows.append(row)
    return done


@pytest.mark.parametrize("layers", [1, 2])
def test_context_tagger_like_a_loop(lively, layers):
    labels, pieces = N.Vocabulary.of(list("abcdef")), lambda w: [ord(c) for c in w]
    size = M.Size(vocabulary=50, embedding=6, units=4, layers=layers, window=WINDOW, pieces=3)
    lists = _lists(1, ["ev", "kitap", "a", "geldi", "su", "iki"])
    tagger = M.ContextTagger(labels, pieces, size, "UNK", seed=5)
    got = tagger.found(M.Tokens.of(lists)).tolist()
    want = [d for x in lists for d, in _context_loop(tagger.net, x, pieces, lambda rows: (rows.argmax(axis=1),))]
    assert got == want and len(set(want)) > 2
    parser = M.ContextParser(labels, pieces, size, seed=8)
    got = list(zip(*(x.tolist() for x in parser.found(M.Tokens.of(lists)))))
    want = [d for x in lists for d in _context_loop(parser.net, x[:WINDOW], pieces, lambda rows: M.decode(rows, WINDOW))]
    assert got == want and len(set(want)) > 2


def _dictionary() -> Y.Dictionaries:
    """Under which words have several readings, and one more than ten."""
    parts = ["Adj", "Adverb", "Noun", "Verb"]
    tags = {"null": [f"{p}+A{k}sg" for p in parts for k in range(3)], "a": ["Noun+Dat", "Verb+Opt"], "i": ["Noun+Acc", "Adj+Acc"], "ki": ["Adj^DB+Noun"]}
    return Y.Dictionaries(tags, {"ev": ["Noun", "Adj"], "su": ["Noun"], "su" + "a": ["Verb"], "kitap": ["Noun", "Adj", "Verb"], "bin": parts})


WORDS = ["ev", "eva", "evi", "su", "sua", "xyz", "kitap", "kitaba", "bin", "."]


def _disambiguator(**options) -> M.Disambiguator:
    d = _dictionary()
    tags = N.Vocabulary.of(sorted({t for v in d.suffixes.values() for x in v for t in x.replace("^", "+").split("+")}), "?")
    size = M.MorphSize(characters=40, tags=len(tags) + 1, embedding=5, units=4, root=4, sequence=4, surface=3, window=WINDOW)
    return M.Disambiguator(d, N.Vocabulary.of(list("abcdefghiıklmnoprstuvyz."), "?"), tags, size, seed=2, **options)


@pytest.mark.parametrize("legacy", [False, True])
def test_disambiguator_like_a_loop(lively, legacy):
    m, lists = _disambiguator(legacy=legacy), _lists(4, WORDS)
    s, want = m.size, []
    word = lambda w, rnn, cut: rnn.run(m.char_embedding[N.padded(m.characters.ids(w), s.surface, "pre", cut)][None])[0]
    for x in lists:
        for t, w in enumerate(x):
            left, right = x[max(0, t - WINDOW) : t], x[t + 1 : t + 1 + WINDOW]
            left = [word("", m.left_word, "pre")] * (WINDOW - len(left)) + [word(v, m.left_word, "pre") for v in left]
            right = [word(v, m.right_word, "pre" if legacy else "post") for v in right] + [word("", m.right_word, "pre")] * (WINDOW - len(right))
            h = np.tanh(m.left.run(np.array([left]))[0] + m.right.run(np.array([right]), backwards=True)[0])
            own = m.readings(w)
            score = []
            for k in range(s.candidates):
                root, _, tags = own[k] if k < len(own) else ("", "", [])
                ids = N.padded(m.characters.ids(root), s.root)[None], N.padded(m.tags.ids(tags), s.sequence)[None]
                score.append(np.tanh(m.root.run(m.char_embedding[ids[0]])[0] + m.sequence.run(m.tag_embedding[ids[1]])[0]) @ h)
            p = m.two.run(m.one.run(np.array([score])))[0] * (np.arange(s.candidates) < len(own))
            want.append(int(p.argmax()))
    assert m.found(M.Tokens.of(lists)).tolist() == want
    assert max(len(m.readings(w)) for w in WORDS) > s.candidates and len(set(want)) > 2


def test_one_reading_asks_no_network(monkeypatch):
    m = _disambiguator()
    monkeypatch.setattr(m, "_words", None)
    assert m.found(M.Tokens.of([["xyz", "."], [], ["xyz"]])).tolist() == [0, 0, 0]


def _trees() -> tuple[M.TreeTagger, M.TreeParser]:
    m, words, labels = _disambiguator(), N.Vocabulary.of(["ev", "su"], "?"), N.Vocabulary.of(list("abcdefg"))
    size = M.TreeSize(words=9, word=3, pos=2, tag_units=3, units=4, history_units=3, dense=(4, 2), window=WINDOW, sequence=4)
    tagger = M.TreeTagger(m, words, labels, size, seed=3)
    return tagger, M.TreeParser(m, tagger, words, labels, size, seed=4)


def _tree_loop(tree, x: list[str], pos: list[int] | None) -> list[tuple]:
    m, s, rows, done = tree.morph, tree.size, [], []

    def vector(w: str | None, reading: str | None, tag: int) -> np.ndarray:
        tags = np.zeros(s.sequence, np.int32) if w is None else tree._tags(reading)
        parts = [tree.embedding[(0 if w is None else tree._word(w, reading)) % s.words], tree.tag_rnn.run(m.tag_embedding[tags][None])[0]]
        return np.concatenate(parts + ([] if pos is None else [tree.pos_embedding[tag]]))

    own, none = [vector(w, r, pos[t] if pos else 0) for t, (w, r) in enumerate(zip(x, m.predict(x)))], vector(None, None, 0)
    for t, now in enumerate(own):
        left, right, past = own[max(0, t - s.window) : t], own[t + 1 : t + 1 + s.window], rows[max(0, t - s.window) : t]
        fill = lambda r: s.window - len(r)
        after = tree.right.run(np.array([right + [none] * fill(right)]))[0]
        if pos is None:
            empty = np.concatenate([none, np.zeros(len(tree.labels) + 1, np.float32)])
            parts = [now, after, tree.left.run(np.array([[empty] * fill(past) + past]))[0]]
        else:
            empty = np.zeros(tree.width, np.float32)
            parts = [now, tree.left.run(np.array([[none] * fill(left) + left]))[0], after, tree.history.run(np.array([[empty] * fill(past) + past]))[0]]
        out = tree.out.run(tree.two.run(tree.one.run(np.concatenate(parts)[None])))
        if pos is None:
            done.append((int(out.argmax()),))
            rows.append(np.concatenate([now, np.eye(len(tree.labels) + 1, dtype=np.float32)[done[-1][0]]]))
        else:
            done.append(tuple(int(d[0]) for d in M.decode(out, s.window)))
            rows.append(np.bincount([done[-1][0], s.window + 1 + done[-1][1]], minlength=tree.width).astype(np.float32))
    return done


def test_trees_like_a_loop(lively):
    tagger, parser = _trees()
    lists = _lists(5, WORDS)
    want = [d for x in lists for d, in _tree_loop(tagger, x, None)]
    assert tagger.found(M.Tokens.of(lists)).tolist() == want and len(set(want)) > 2
    want = [d for x in lists for d in _tree_loop(parser, x[:WINDOW], [k for k, in _tree_loop(tagger, x[:WINDOW], None)])]
    assert list(zip(*(a.tolist() for a in parser.found(M.Tokens.of(lists))))) == want and len(set(want)) > 2


def test_parser_reads_words_once(monkeypatch):
    """It shares the disambiguator's readings with its tagger."""
    _, parser = _trees()
    calls, found = [], M.Disambiguator.found
    monkeypatch.setattr(M.Disambiguator, "found", lambda self, tokens: calls.append(1) or found(self, tokens))
    parser.predict_batch(_lists(6, WORDS))
    assert calls == [1]


@pytest.mark.parametrize("model", ["pos:context", "ner:context", "dep:context", "pos:tree", "dep:tree"])
def test_blocks_are_bounded(monkeypatch, model):
    """However many lists a batch has, the networks see a bounded number of places."""
    name, _, variant = model.partition(":")
    seen, run = [], N.Contexts.start
    monkeypatch.setattr(N.Contexts, "start", lambda self, places, lists: seen.append((places * lists, self.layers[0].units)) or run(self, places, lists))
    serve.Tagger(name, variant).predict_batch([["ev", "geldi", ","] * 10] * 700)
    assert len(seen) > 2 and all(n <= max(M._LEAST, M._CELLS // units) for n, units in seen)


def test_texts_are_read_in_bounded_numbers(monkeypatch):
    tagger = serve.Tagger("ner", "characters")
    seen, read = [], M.CharTagger.characters_of
    monkeypatch.setattr(M.CharTagger, "characters_of", lambda self, texts: seen.append(len(texts)) or read(self, texts))
    lists = [["Ali", "x" * 300, "bir"], [], ["y"]] * 300 + [["z" * 400]]
    got = tagger.predict_batch(lists)
    assert [len(x) for x in got] == [3, 0, 1] * 300 + [1] and got[:3] == [tagger.predict(x) for x in lists[:3]]
    assert sum(seen) > max(seen) and max(seen) <= M._rows(tagger.model.size.units)


def test_sentiment_keeps_no_texts():
    """Whole texts hardly come again: a cache of theirs only fills memory."""
    assert not hasattr(serve.SentimentAnalyzer().model.pieces, "cache_info")


@pytest.mark.parametrize("model", ["stemmer", "pos:context", "ner:characters", "dep:context", "dep:tree"])
def test_arrow_like_lists(model):
    name, _, variant = model.partition(":")
    tagger = serve.Tagger(name, variant or None)
    rows = [[["Ali", "eve"], ["geldi"]], None, [], [[], ["a"] * 45], [["son"]]]
    nested = pa.array(rows, pa.list_(pa.list_(pa.string())))
    fields = {"stemmer": None, "dep": ("id", "word", "head", "rel")}.get(name, ("token", "tag"))
    for begin in (0, 2):
        for cut in (None, 2):
            want = []
            for row in rows[begin:]:
                chunks = [c[i : i + (cut or len(c))] for c in row or [] for i in range(0, len(c), cut or len(c) or 1)]
                flat = [x for own in tagger.predict_batch(chunks) for x in own]
                want.append([dict(zip(fields, x)) for x in flat] if fields else flat)
            assert serve.results(tagger.model, name, nested[begin:], cut).to_pylist() == want


def test_one_worker_for_all_models(spark):
    df = spark.createDataFrame([([["Ali", "geldi"]], "Ali geldi")], "tokens_40 array<array<string>>, no_accents string")
    out = serve.annotated(df, serve.resolve(["stemmer", "pos", "ner", "dep", "sentiment"]))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [len(x) for x in out.select("morph", "pos", "ner", "dep").first()] == [2] * 4


@pytest.mark.parametrize("name", ["stemmer", "pos_tree", "dep_tree", "ner_characters", "sentiment_scores", "sentence_pipeline"])
def test_models_run_once(spark, small, name):
    """No filter on an explode's input runs them a second time."""
    from kavram.plans import queries as Q

    assert Q.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
