"""The models, each a function of a batch of token lists.

Every model gives the same for a sentence alone and in a batch. Lists are taken
in blocks of a bounded number of tokens, those of similar length together. Words
are encoded once for a block, however often a context shows them; only the
branch that reads earlier decisions goes through the tokens one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain

import numpy as np

from ..operators.morphology import Analysis, Dictionaries, analyses, capitalize
from .networks import Both, Contexts, Dense, Gru, Stack, Vocabulary, Weights, all_padded, padded

Pieces = Callable[[str], list[int]]
#: Numbers of a state that is kept for every token of a block, and tokens of a block at least.
_CELLS, _LEAST = 1 << 16, 512
#: Rows that are encoded together.
_SLICE = 4096


class Tokens:
    """Token lists by the numbers of their distinct words.

    words: of the numbers from 0; codes: the lists' words, one list after the
    other; sizes: of the lists. Results are in the order of codes."""

    def __init__(self, words: list[str], codes: np.ndarray, sizes: np.ndarray):
        self.words, self.codes, self.sizes = words, codes, sizes
        self.begin = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, lists: list[list[str]]) -> Tokens:
        number: dict[str, int] = {}
        codes = [number.setdefault(w, len(number)) for x in lists for w in x]
        return cls(list(number), np.array(codes, dtype=np.int64), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))

    def cut(self, n: int) -> Tokens:
        """The lists' first n tokens."""
        place = np.arange(len(self.codes)) - np.repeat(self.begin, self.sizes)
        return Tokens(self.words, self.codes[place < n], np.minimum(self.sizes, n))

    def lists(self, flat: list) -> list[list]:
        return [flat[a : a + n] for a, n in zip(self.begin.tolist(), self.sizes.tolist())]

    def blocks(self, units: int, only: np.ndarray | None = None) -> Iterator[Block]:
        """The lists that aren't empty, or those of them that ``only`` names, longest first."""
        chosen = np.arange(len(self.sizes)) if only is None else only
        chosen = chosen[self.sizes[chosen] > 0]
        chosen = chosen[np.argsort(-self.sizes[chosen], kind="stable")]
        most, a = max(_LEAST, _CELLS // units), 0
        while a < len(chosen):
            some = chosen[a : a + max(1, most // int(self.sizes[chosen[a]]))]
            yield Block(self.begin[some], self.sizes[some])
            a += len(some)


class Block:
    """Lists side by side: arrays of (places, lists), of which those beyond a list's end stand for nothing."""

    def __init__(self, begin: np.ndarray, sizes: np.ndarray):
        place = np.arange(sizes[0])[:, None]
        self.real = place < sizes
        self.where = np.where(self.real, begin + place, 0)
        self.turned = np.where(self.real, sizes - 1 - place, 0)
        self.each = np.arange(len(sizes))

    def numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, and their numbers from 1 at each place; beyond a list's end 0."""
        kinds, found = np.unique(codes[self.where[self.real]], return_inverse=True)
        out = np.zeros(self.real.shape, dtype=np.int64)
        out[self.real] = found + 1
        return kinds, out

    def before(self, contexts: Contexts, projected: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return contexts.run(projected, numbers)

    def after(self, contexts: Contexts, projected: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """States by what follows each place."""
        return contexts.run(projected, np.where(self.real, numbers[self.turned, self.each], 0))[:, self.turned, self.each]

    def decided(self, history: Contexts, fixed: np.ndarray, outputs: Callable[[np.ndarray], np.ndarray], decide: Callable[[int, np.ndarray], np.ndarray]) -> None:
        """fixed: (places, lists, inputs), what doesn't depend on earlier decisions.
        decide: from a place and its lists' outputs to the projected rows of the history, (3 units, lists)."""
        places, lists = self.real.shape
        states = history.start(places, lists)
        for place in range(places):
            x = np.concatenate([fixed[place], states[-1][:, place].T], axis=1)
            history.read(states, place, decide(place, outputs(x)))


def _sliced(run: Callable[[np.ndarray], np.ndarray], rows: np.ndarray) -> np.ndarray:
    return np.concatenate([run(rows[a : a + _SLICE]) for a in range(0, len(rows), _SLICE)])


def _by_kind(run: Callable[[np.ndarray], np.ndarray], rows: np.ndarray) -> np.ndarray:
    """run, of every different row once."""
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return _sliced(run, rows[first])[number]


def _places_last(*parts: np.ndarray) -> np.ndarray:
    """(units, places, lists) of several branches as one (places, lists, inputs)."""
    return np.concatenate(parts).transpose(1, 2, 0).copy()


@dataclass(frozen=True)
class Size:
    """Of the taggers that see word pieces in context."""

    vocabulary: int = 16_000
    embedding: int = 128
    units: int = 128
    layers: int = 1
    dense: tuple[int, int] = (2, 1)
    window: int = 40
    pieces: int = 8


class ContextNet:
    """The current word, those before and after it, and the decisions so far."""

    def __init__(self, w: Weights, s: Size, history: int, outputs: int, activation: str):
        self.size = s
        self.embedding = w.take(s.vocabulary, s.embedding)
        self.word = Stack(w, s.embedding, s.units, s.layers)
        self.left = Stack(w, s.units, s.units, s.layers)
        self.right = Stack(w, s.units, s.units, s.layers, backwards=True)
        self.history = Stack(w, history, s.units, s.layers)
        self.one = Dense(w, 4 * s.units, s.units * s.dense[0], "relu")
        self.two = Dense(w, s.units * s.dense[0], s.units * s.dense[1], "relu")
        self.out = Dense(w, s.units * s.dense[1], outputs, activation)
        w.close()

    def _word(self, ids: np.ndarray) -> np.ndarray:
        return self.word.run(self.embedding[ids % self.size.vocabulary])

    @cached_property
    def contexts(self) -> tuple[Contexts, Contexts, Contexts]:
        none = self._word(np.zeros((1, self.size.pieces), np.int32)).T
        of = lambda stack, row: Contexts(stack.layers, row, self.size.window, stack.backwards)
        return of(self.left, self.left.layers[0].columns(none)), of(self.right, self.right.layers[0].columns(none)), of(self.history, self.history.layers[0].bias[0][:, None])

    def run(self, tokens: Tokens, pieces: Pieces, decide: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """decide: from rows of outputs to decisions, each an array; the rows of the history's kernel that stand for
        a decision are those of its numbers, the second's after the ``window + 1`` of the first."""
        s, first = self.size, self.history.layers[0]
        kernel = first.kernel.T
        left, right, history = self.contexts
        found: tuple[np.ndarray, ...] | None = None
        for block in tokens.blocks(s.units):
            kinds, numbers = block.numbers(tokens.codes)
            ids = np.concatenate([np.zeros((1, s.pieces), np.int32), all_padded([pieces(tokens.words[k]) for k in kinds.tolist()], s.pieces)])
            vectors = np.ascontiguousarray(_sliced(self._word, ids).T)
            before = block.before(left, self.left.layers[0].columns(vectors), numbers)
            after = block.after(right, self.right.layers[0].columns(vectors), numbers)
            fixed = _places_last(vectors[:, numbers], before, after)

            def step(place: int, rows: np.ndarray) -> np.ndarray:
                nonlocal found
                own, real = decide(rows), block.real[place]
                if found is None:
                    found = tuple(np.zeros(len(tokens.codes), np.int64) for _ in own)
                for into, x in zip(found, own):
                    into[block.where[place, real]] = x[real]
                row = kernel[:, own[0]] if len(own) == 1 else kernel[:, own[0]] + kernel[:, s.window + 1 + own[1]]
                return row + first.bias[0][:, None]

            block.decided(history, fixed, lambda x: self.out.run(self.two.run(self.one.run(x))), step)
        return found or tuple(np.zeros(0, np.int64) for _ in decide(np.zeros((1, len(self.out.bias)), np.float32)))


class _Lists:
    """What a model gives for lists of words."""

    def predict_batch(self, sentences: list[list[str]]) -> list[list]:
        tokens = Tokens.of(sentences)
        return self.named(tokens, self.found(tokens))

    def predict(self, tokens: list[str]) -> list:
        return self.predict_batch([tokens])[0]


class _Tagged(_Lists):
    labels: Vocabulary
    missing = "UNK"

    def name(self, k: int) -> str:
        return self.labels.words.get(k, self.missing)

    def named(self, tokens: Tokens, found: np.ndarray) -> list[list[tuple[str, str]]]:
        return tokens.lists([(tokens.words[c], self.name(k)) for c, k in zip(tokens.codes.tolist(), found.tolist())])


class _Parsed(_Lists):
    """Lists are cut to the window."""

    labels: Vocabulary
    window: int

    def name(self, k: int) -> str:
        return self.labels.words.get(k, "UNK")

    def named(self, tokens: Tokens, found: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, str, int, str]]]:
        cut = tokens.cut(self.window)
        rows = cut.lists([(cut.words[c], arc, self.name(k)) for c, arc, k in zip(cut.codes.tolist(), *(x.tolist() for x in found))])
        return [[(t, *x) for t, x in enumerate(own, 1)] for own in rows]


class ContextTagger(_Tagged):
    """Parts of speech (17 labels) or named entities (4 labels), by word pieces in context."""

    def __init__(self, labels: Vocabulary, pieces: Pieces, size: Size, missing: str, weights: list[np.ndarray] | None = None, seed: int = 0):
        w = Weights(weights, seed)
        self.labels, self.pieces, self.missing = labels, pieces, missing
        self.net = ContextNet(w, size, len(labels) + 1, len(labels) + 1, "softmax")
        self.parameters = w.parameters

    def found(self, tokens: Tokens) -> np.ndarray:
        """The labels' numbers."""
        return self.net.run(tokens, self.pieces, lambda rows: (rows.argmax(axis=1),))[0]


class ContextParser(_Parsed):
    """Heads and relations of up to a window of tokens; longer sentences are cut, or refused if strict."""

    def __init__(self, labels: Vocabulary, pieces: Pieces, size: Size, weights: list[np.ndarray] | None = None, seed: int = 0, strict: bool = False):
        w = Weights(weights, seed)
        self.labels, self.pieces, self.window, self.strict = labels, pieces, size.window, strict
        width = size.window + 1 + len(labels) + 1
        self.net = ContextNet(w, size, width, width, "sigmoid")
        self.parameters = w.parameters

    def found(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Heads and the relations' numbers of the cut lists."""
        if self.strict and (tokens.sizes > self.window).any():
            raise ValueError(f"a sentence has more than {self.window} tokens")
        return self.net.run(tokens.cut(self.window), self.pieces, lambda rows: decode(rows, self.window))


def decode(rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return rows[:, : window + 1].argmax(axis=1), rows[:, window + 1 :].argmax(axis=1)


@dataclass(frozen=True)
class MorphSize:
    characters: int = 116
    tags: int = 127
    embedding: int = 32
    units: int = 128
    candidates: int = 10
    root: int = 10
    sequence: int = 15
    surface: int = 15
    window: int = 40


class Disambiguator(_Lists):
    """Chooses one of the candidates of each token by its context.

    The first ``candidates`` readings are compared; more than that count in the
    mask only. Words of a right context lose their last characters if they are
    too long (their first ones if ``legacy``). A token with one reading has that
    one, whatever its context, so only lists with others are put to the network."""

    def __init__(self, dictionaries: Dictionaries, characters: Vocabulary, tags: Vocabulary, size: MorphSize = MorphSize(), weights: list[np.ndarray] | None = None, seed: int = 0, capitalize_names: bool = True, legacy: bool = False):
        w, s = Weights(weights, seed), size
        self.size, self.dictionaries, self.characters, self.tags = s, dictionaries, characters, tags
        self.capitalize_names, self.legacy = capitalize_names, legacy
        self.char_embedding = w.take(s.characters, s.embedding)
        self.tag_embedding = w.take(s.tags, s.embedding)
        self.root, self.sequence = Both(w, s.embedding, s.units), Both(w, s.embedding, s.units)
        self.left_word, self.right_word = Both(w, s.embedding, 2 * s.units), Both(w, s.embedding, 2 * s.units)
        self.left, self.right = Gru(w, 4 * s.units, 2 * s.units), Gru(w, 4 * s.units, 2 * s.units)
        self.one, self.two = Dense(w, s.candidates, 2 * s.candidates, "tanh"), Dense(w, 2 * s.candidates, s.candidates, "softmax")
        w.close()
        self.parameters = w.parameters
        self.known: dict[str, list[Analysis]] = {}

    def readings(self, token: str) -> list[Analysis]:
        if token not in self.known:
            if len(self.known) > 1 << 18:
                self.known.clear()
            self.known[token] = analyses(token, self.dictionaries)
        return self.known[token]

    @cached_property
    def contexts(self) -> tuple[Contexts, Contexts]:
        none = np.zeros((1, self.size.surface), np.int32)
        of = lambda word, gru, back: Contexts([gru], gru.columns(word.run(self.char_embedding[none]).T), self.size.window, back)
        return of(self.left_word, self.left, False), of(self.right_word, self.right, True)

    def found(self, tokens: Tokens) -> np.ndarray:
        """The chosen readings' places."""
        s = self.size
        own = [self.readings(w) for w in tokens.words]
        counts = np.array([len(x) for x in own], dtype=np.int64)
        several = counts[tokens.codes] > 1
        best = np.zeros(len(tokens.codes), dtype=np.int64)
        lists = np.repeat(np.arange(len(tokens.sizes)), tokens.sizes)
        for block in tokens.blocks(2 * s.units, np.unique(lists[several])):
            kinds, numbers = block.numbers(tokens.codes)
            words = [tokens.words[k] for k in kinds.tolist()]
            before = block.before(self.contexts[0], self._words(words, "pre", self.left_word, self.left), numbers)
            after = block.after(self.contexts[1], self._words(words, "pre" if self.legacy else "post", self.right_word, self.right), numbers)
            which = block.real & several[block.where]
            h = np.tanh(before[:, which] + after[:, which]).T
            of, kind = np.unique(numbers[which] - 1, return_inverse=True)
            reading = self._readings([own[k] for k in kinds[of].tolist()])
            p = np.concatenate([np.einsum("ncu,nu->nc", reading[kind[a : a + _SLICE]], h[a : a + _SLICE]) for a in range(0, len(h), _SLICE)])
            mask = np.arange(s.candidates)[None] < counts[kinds[of]][kind][:, None]
            best[block.where[which]] = (self.two.run(self.one.run(p)) * mask).argmax(axis=1)
        return best

    def _words(self, words: list[str], cut: str, rnn: Both, gru: Gru) -> np.ndarray:
        """The words as a context shows them, after the empty one."""
        ids = np.concatenate([np.zeros((1, self.size.surface), np.int32), all_padded([self.characters.ids(w) for w in words], self.size.surface, "pre", cut)])
        return gru.columns(_sliced(lambda x: rnn.run(self.char_embedding[x]), ids).T)

    def _readings(self, own: list[list[Analysis]]) -> np.ndarray:
        """(words, candidates, 2 units); those that a word doesn't have are of empty ones."""
        s = self.size
        at = [i * s.candidates + j for i, x in enumerate(own) for j in range(min(len(x), s.candidates))]
        some = [reading for x in own for reading in x[: s.candidates]]
        roots, tags = np.zeros((len(own) * s.candidates, s.root), np.int32), np.zeros((len(own) * s.candidates, s.sequence), np.int32)
        roots[at] = all_padded([self.characters.ids(root) for root, _, _ in some], s.root)
        tags[at] = all_padded([self.tags.ids(sequence) for _, _, sequence in some], s.sequence)
        return np.tanh(_by_kind(lambda x: self.root.run(self.char_embedding[x]), roots) + _by_kind(lambda x: self.sequence.run(self.tag_embedding[x]), tags)).reshape(len(own), s.candidates, -1)

    def text(self, word: str, k: int) -> str:
        """Root and tags of a word's reading."""
        root, _, sequence = self.readings(word)[k]
        if self.capitalize_names and "Prop" in sequence:
            root = capitalize(root)
        return "+".join([root, *sequence]).replace("+DB", "^DB")

    def pairs(self, tokens: Tokens, found: np.ndarray) -> tuple[np.ndarray, list[tuple[str, str]]]:
        """(word, text of its reading), each once, and their numbers by token."""
        kinds, number = np.unique(tokens.codes << 32 | found, return_inverse=True)
        return number, [(tokens.words[x >> 32], self.text(tokens.words[x >> 32], x & 0xFFFFFFFF)) for x in kinds.tolist()]

    def named(self, tokens: Tokens, found: np.ndarray) -> list[list[str]]:
        number, pairs = self.pairs(tokens, found)
        return tokens.lists([pairs[k][1] for k in number.tolist()])


@dataclass(frozen=True)
class TreeSize:
    words: int = 16_000
    word: int = 128
    pos: int = 8
    tag_units: int = 128
    units: int = 256
    history_units: int = 128
    layers: int = 2
    dense: tuple[int, int] = (8, 4)
    window: int = 40
    sequence: int = 15


class _Tree:
    """What the two taggers on top of the disambiguator share. word_form: the
    whole word, or its root if only that is known; or the other way round."""

    def __init__(self, morph: Disambiguator, words: Vocabulary, size: TreeSize, word_form: str):
        self.morph, self.words, self.size, self.word_form = morph, words, size, word_form

    def _word(self, token: str, reading: str) -> int:
        root = reading.split("+")[0]
        pair = (token, root) if self.word_form == "whole" else (root, token)
        ids = [self.words.ids([w]) for w in pair]
        found = ids[0] or ids[1]
        return found[0] if found else 0

    def _tags(self, reading: str) -> np.ndarray:
        return padded(self.morph.tags.ids(reading.replace("^", "+").split("+")[1:]), self.size.sequence)

    def _kinds(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """Vectors (units, pairs) of word and tags; the first of none."""
        words = np.array([0, *(self._word(w, r) for w, r in pairs)]) % self.size.words
        tags = np.stack([np.zeros(self.size.sequence, np.int32), *(self._tags(r) for _, r in pairs)])
        return np.concatenate([self.embedding[words], _by_kind(lambda x: self.tag_rnn.run(self.morph.tag_embedding[x]), tags)], axis=1).T

    def _output(self, x: np.ndarray) -> np.ndarray:
        return self.out.run(self.two.run(self.one.run(x)))


class TreeTagger(_Tree, _Tagged):
    """Parts of speech from words, their analyses and the decisions so far."""

    def __init__(self, morph: Disambiguator, words: Vocabulary, labels: Vocabulary, size: TreeSize = TreeSize(), word_form: str = "whole", weights: list[np.ndarray] | None = None, seed: int = 0):
        super().__init__(morph, words, size, word_form)
        w, s = Weights(weights, seed), size
        self.labels, classes = labels, len(labels) + 1
        self.embedding = w.take(s.words, s.word)
        self.tag_rnn = Stack(w, morph.size.embedding, s.tag_units, s.layers)
        both = s.word + s.tag_units
        self.left, self.right = Stack(w, both + classes, s.units, s.layers), Stack(w, both, s.units, s.layers, backwards=True)
        self.one = Dense(w, both + 2 * s.units, s.tag_units * s.dense[0], "relu")
        # weights have the left context before the right one; here the branch with decisions comes last
        self.one.kernel = np.concatenate([self.one.kernel[:both], self.one.kernel[both + s.units :], self.one.kernel[both : both + s.units]])
        self.two = Dense(w, s.tag_units * s.dense[0], s.tag_units * s.dense[1], "relu")
        self.out = Dense(w, s.tag_units * s.dense[1], classes, "sigmoid")
        w.close()
        self.parameters = w.parameters

    @cached_property
    def contexts(self) -> tuple[Contexts, Contexts]:
        none, (left, right) = self._kinds([]), (x.layers[0] for x in (self.left, self.right))
        return Contexts(self.left.layers, left.kernel[: len(none)].T @ none + left.bias[0][:, None], self.size.window), Contexts(self.right.layers, right.columns(none), self.size.window, True)

    def found(self, tokens: Tokens) -> np.ndarray:
        return self.of_readings(tokens, *self.morph.pairs(tokens, self.morph.found(tokens)))

    def of_readings(self, tokens: Tokens, number: np.ndarray, pairs: list[tuple[str, str]]) -> np.ndarray:
        """The labels' numbers. number, pairs: the tokens' words and readings."""
        out = np.zeros(len(tokens.codes), np.int64)
        left, right = self.contexts
        first = self.left.layers[0]
        for block in tokens.blocks(self.size.units):
            kinds, numbers = block.numbers(number)
            vectors = self._kinds([pairs[k] for k in kinds.tolist()])
            after = block.after(right, self.right.layers[0].columns(vectors), numbers)
            width = len(vectors)
            projected, labels = first.kernel[:width].T @ vectors + first.bias[0][:, None], first.kernel[width:].T

            def step(place: int, rows: np.ndarray) -> np.ndarray:
                k, real = rows.argmax(axis=1), block.real[place]
                out[block.where[place, real]] = k[real]
                return projected[:, numbers[place]] + labels[:, k]

            block.decided(left, _places_last(vectors[:, numbers], after), self._output, step)
        return out


class TreeParser(_Tree, _Parsed):
    """Heads and relations from words, analyses, parts of speech and the decisions so far."""

    def __init__(self, morph: Disambiguator, tagger: TreeTagger | ContextTagger, words: Vocabulary, labels: Vocabulary, size: TreeSize = TreeSize(), word_form: str = "whole", weights: list[np.ndarray] | None = None, seed: int = 0):
        super().__init__(morph, words, size, word_form)
        w, s = Weights(weights, seed), size
        self.tagger, self.labels, self.window, self.width = tagger, labels, s.window, s.window + len(labels) + 2
        self.embedding = w.take(s.words, s.word)
        self.pos_embedding = w.take(len(tagger.labels) + 1, s.pos)
        self.tag_rnn = Stack(w, morph.size.embedding, s.tag_units, 2)
        both = s.word + s.tag_units + s.pos
        self.left, self.history = Stack(w, both, s.units, 2), Stack(w, self.width, s.history_units, 2)
        self.right = Stack(w, both, s.units, 2, backwards=True)
        self.one = Dense(w, both + 2 * s.units + s.history_units, s.tag_units * s.dense[0], "relu")
        # weights have the decisions before the right context; here they come last
        start = both + s.units
        self.one.kernel = np.concatenate([self.one.kernel[:start], self.one.kernel[start + s.history_units :], self.one.kernel[start : start + s.history_units]])
        self.two = Dense(w, s.tag_units * s.dense[0], s.tag_units * s.dense[1], "relu")
        self.out = Dense(w, s.tag_units * s.dense[1], self.width, "sigmoid")
        w.close()
        self.parameters = w.parameters

    def _vectors(self, pairs: list[tuple[str, str]], which: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """(units, kinds), the first of none. which: the kinds' pairs; pos: their parts of speech."""
        return np.concatenate([self._kinds(pairs)[:, np.concatenate([[0], which + 1])], self.pos_embedding[np.concatenate([[0], pos])].T])

    @cached_property
    def contexts(self) -> tuple[Contexts, Contexts, Contexts]:
        none = self._vectors([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        of = lambda stack, row: Contexts(stack.layers, row, self.size.window, stack.backwards)
        return of(self.left, self.left.layers[0].columns(none)), of(self.right, self.right.layers[0].columns(none)), of(self.history, self.history.layers[0].bias[0][:, None])

    def found(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Heads and the relations' numbers of the cut lists."""
        tokens = tokens.cut(self.size.window)
        number, pairs = self.morph.pairs(tokens, self.morph.found(tokens))
        tagged = self.tagger.of_readings(tokens, number, pairs) if isinstance(self.tagger, TreeTagger) and self.tagger.morph is self.morph else self.tagger.found(tokens)
        tags, own = np.unique(tagged, return_inverse=True)
        pos = np.array([(self.tagger.labels.ids([self.tagger.name(k)]) or [0])[0] for k in tags.tolist()], dtype=np.int64)[own]
        arcs, labels = np.zeros(len(tokens.codes), np.int64), np.zeros(len(tokens.codes), np.int64)
        left, right, history = self.contexts
        first = self.history.layers[0]
        kernel = first.kernel.T
        for block in tokens.blocks(self.size.units):
            kinds, numbers = block.numbers(number << 32 | pos)
            some, which = np.unique(kinds >> 32, return_inverse=True)
            vectors = self._vectors([pairs[k] for k in some.tolist()], which, kinds & 0xFFFFFFFF)
            before = block.before(left, self.left.layers[0].columns(vectors), numbers)
            after = block.after(right, self.right.layers[0].columns(vectors), numbers)

            def step(place: int, rows: np.ndarray) -> np.ndarray:
                (arc, label), real = decode(rows, self.window), block.real[place]
                at = block.where[place, real]
                arcs[at], labels[at] = arc[real], label[real]
                return kernel[:, arc] + kernel[:, self.window + 1 + label] + first.bias[0][:, None]

            block.decided(history, _places_last(vectors[:, numbers], before, after), self._output, step)
        return arcs, labels


@dataclass(frozen=True)
class CharSize:
    characters: int = 150
    embedding: int = 32
    units: int = 128
    layers: int = 5
    dense: int = 32
    length: int = 256


class CharTagger(_Tagged):
    """Named entities by character: a token's label is the most frequent of its
    characters', the lowest of several. Token lists whose text is longer than the
    model's are halved until they fit."""

    missing = "O"

    def __init__(self, characters: Vocabulary, labels: Vocabulary, size: CharSize = CharSize(), weights: list[np.ndarray] | None = None, seed: int = 0):
        w, s = Weights(weights, seed), size
        self.characters, self.labels, self.size = characters, labels, s
        self.embedding = w.take(s.characters, s.embedding)
        self.layers = [Both(w, s.embedding if i == 0 else 2 * s.units, s.units) for i in range(s.layers)]
        self.dense, self.out = Dense(w, 2 * s.units, s.dense, "relu"), Dense(w, s.dense, len(labels) + 1, "softmax")
        w.close()
        self.parameters = w.parameters

    def characters_of(self, texts: list[str]) -> np.ndarray:
        """(texts, length) label ids."""
        ids = all_padded([self.characters.ids(t) for t in texts], self.size.length, "post") % self.size.characters
        x = self.embedding[ids]
        for layer in self.layers:
            x = layer.run(x, sequences=True)
        return self.out.run(self.dense.run(x)).argmax(axis=-1)

    def _parts(self, tokens: list[str]) -> list[list[str]]:
        if len(tokens) < 2 or len(" ".join(tokens)) <= self.size.length:
            return [tokens] if tokens else []
        half = len(tokens) // 2
        return self._parts(tokens[:half]) + self._parts(tokens[half:])

    def found(self, tokens: Tokens) -> np.ndarray:
        """The labels' numbers."""
        lists = tokens.lists(tokens.codes.tolist())
        parts = [p for x in lists for p in self._parts([tokens.words[c] for c in x])]
        out, done, many = np.zeros(len(tokens.codes), np.int64), 0, _rows(self.size.units)
        classes = len(self.labels) + 1
        for a in range(0, len(parts), many):
            some = parts[a : a + many]
            labels = self.characters_of([" ".join(p) for p in some])
            sizes = np.fromiter(map(len, chain.from_iterable(some)), dtype=np.int64)
            of = np.repeat(np.arange(len(some)), [len(p) for p in some])
            begin = np.cumsum(sizes + 1) - sizes - 1
            begin -= begin[np.searchsorted(of, of)]  # in its own text
            end = np.minimum(begin + sizes, labels.shape[1])
            inside = np.maximum(end - begin, 0)  # characters beyond the model's length have no label
            token = np.repeat(np.arange(len(sizes)), inside)
            place = np.arange(len(token)) - np.repeat(np.cumsum(inside) - inside, inside) + begin[token]
            counts = np.bincount(token * classes + labels[of[token], place], minlength=len(sizes) * classes).reshape(-1, classes)
            out[done : done + len(sizes)] = counts.argmax(axis=1)
            done += len(sizes)
        return out


def _rows(units: int) -> int:
    """Texts that are read together."""
    return max(64, 4096 // units)


@dataclass(frozen=True)
class SentimentSize:
    vocabulary: int = 16_000
    embedding: int = 128
    units: int = 128
    layers: int = 3
    length: int = 256


class Sentiment:
    """The probability that a text is positive; of blank texts exactly a half."""

    def __init__(self, pieces: Pieces, size: SentimentSize = SentimentSize(), weights: list[np.ndarray] | None = None, seed: int = 0):
        w, s = Weights(weights, seed), size
        self.pieces, self.size = pieces, s
        self.embedding = w.take(s.vocabulary, s.embedding)
        self.layers = [Both(w, s.embedding if i == 0 else 2 * s.units, s.units) for i in range(s.layers)]
        self.dense, self.out = Dense(w, 2 * s.units, max(1, s.units // 8), "relu"), Dense(w, max(1, s.units // 8), 1, "sigmoid")
        w.close()
        self.parameters = w.parameters

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        some = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        many = _rows(self.size.units)
        for a in range(0, len(some), many):
            part = some[a : a + many]
            x = self.embedding[all_padded([self.pieces(texts[i]) for i in part], self.size.length, "pre", "post") % self.size.vocabulary]
            for layer in self.layers:
                x = layer.run(x, sequences=True)
            out[part] = self.out.run(self.dense.run(x.mean(axis=1)))[:, 0]
        return out

    def predict(self, texts: list[str | None]) -> list[int]:
        return [int(p > 0.5) for p in self.probabilities(texts)]


def small(size, **fields):
    """A size with some fields changed, for tests."""
    return replace(size, **fields)
