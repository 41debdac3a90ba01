"""Turkish letters for words that were typed with ASCII letters only.

A table gives, for each of c, g, o, s, u and i, patterns of the letters around an
X with signed ranks. Going from left to right, each letter's context (ten letters
either side) is matched, and the pattern of least absolute rank decides by its
sign; letters that were put right count in the contexts of those after them.
The table is an asset of the user's, a JSON file ``{letter: {pattern: rank}}``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

SIZE = 10
_PAIRS = dict(zip("cCgGoOuUiIsS", "çÇğĞöÖüÜıİşŞ"))
_TOGGLE = _PAIRS | {v: k for k, v in _PAIRS.items()}
_BASE = {v: k for k, v in _PAIRS.items()}  # accented to plain; dotless i to i, dotted capital to I
_LETTERS = [chr(x) for x in range(97, 123)]
#: after the letter: every letter in plain lower case
_RIGHT = {c: c for c in _LETTERS} | {c.upper(): c for c in _LETTERS} | {k: v.lower() for k, v in _BASE.items()}
#: before the letter: accented ones as capitals, but the dotted capital I as i
_LEFT = {c: c for c in _LETTERS} | {c.upper(): c for c in _LETTERS} | {k: v.upper() for k, v in _BASE.items()} | {"İ": "i"}

#: Only these letters can be changed.
_UNSURE = re.compile("[" + "".join(_TOGGLE) + "]")

Table = dict[str, dict[str, int]]


def read_table(path: str) -> Table:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _context(text: list[str], at: int) -> str:
    """Up to ten letters either side of X, other signs as one space that ends the right side."""
    right: list[str] = []
    for ch in text[at + 1 :]:
        if len(right) == SIZE:
            break
        letter = _RIGHT.get(ch)
        if letter is None:
            right.append(" ")
            break
        right.append(letter)
    left: list[str] = []
    space = False
    for ch in reversed(text[:at]):
        if len(left) == SIZE:
            break
        letter = _LEFT.get(ch)
        if letter is not None:
            left.append(letter)
            space = False
        elif not space:
            left.append(" ")
            space = True
    return "".join(reversed(left)).rjust(SIZE) + "X" + "".join(right)


_known_shapes: dict[int, tuple[dict, list]] = {}


def _shapes(patterns: dict[str, int]) -> list[tuple[int, int]]:
    """(letters before X, letters after it) of the patterns: few, whatever their number."""
    held = _known_shapes.get(id(patterns))
    if held is None or held[0] is not patterns:
        held = _known_shapes[id(patterns)] = (patterns, sorted({(p.index("X"), len(p) - p.index("X") - 1) for p in patterns if "X" in p}))
    return held[1]


def _accented(patterns: dict[str, int], context: str) -> bool:
    rank = 2 * len(patterns)
    for before, after in _shapes(patterns):
        if before <= SIZE and SIZE + 1 + after <= len(context):
            found = patterns.get(context[SIZE - before : SIZE + 1 + after])
            if found and abs(found) < abs(rank):
                rank = found
    return rank > 0


def deasciified(word: str, table: Table) -> str:
    text = list(word)
    for at, ch in enumerate(text):
        base = _BASE.get(ch, ch)
        patterns = table.get(base.lower())
        match = bool(patterns) and _accented(patterns, _context(text, at))
        # a capital I is the accented form of its own pair: the decision is turned round
        if match != ((base == "I") == (ch == base)):
            text[at] = _TOGGLE.get(ch, ch)
    return "".join(text)


def deasciify_udf(table: Table):
    """array<string> to array<string>; a batch's distinct words are looked at, and a task keeps frequent ones from one batch to the next."""

    @F.arrow_udf("array<string>")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = lru_cache(maxsize=1 << 16)(lambda word: deasciified(word, table) if word and _UNSURE.search(word) else word)
        for batch in batches:
            coded = batch.flatten().dictionary_encode()
            words = pa.array([one(w) for w in coded.dictionary.to_pylist()], pa.string())
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), words.take(coded.indices))

    return convert


def deasciify(tokens: Column, table: Table) -> Column:
    return deasciify_udf(table)(tokens)
