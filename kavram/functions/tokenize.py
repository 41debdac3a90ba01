"""Column functions that cut text into tokens and tokens into chunks.

The patterns name letters and numbers by category: Java's word class is ASCII
only, and its Unicode variant joins combining marks and leaves out superscripts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WORD = r"[\p{L}\p{N}_]"
_NEITHER = r"[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]"
TREEBANK = rf"{_WORD}+(?:[-’/']{_WORD}+)*|{_NEITHER}"
WORD_PUNCT = rf"{_WORD}+|{_NEITHER}+"

#: Tokens of a chunk, the longest input of the taggers.
CHUNK = 40


def _all(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def treebank(c: Column) -> Column:
    """Words with inner hyphens, slashes and apostrophes are one token; every other sign is one."""
    return F.transform(_all(c, TREEBANK), lambda t: F.replace(t, F.lit("’"), F.lit("'")))


def treebank_legacy(c: Column) -> Column:
    """As treebank, but a lone curly apostrophe stays."""
    return F.transform(_all(c, TREEBANK), lambda t: F.when(t == "’", t).otherwise(F.replace(t, F.lit("’"), F.lit("'"))))


def word_punct(c: Column) -> Column:
    """Runs of word characters and runs of other signs."""
    return _all(c, WORD_PUNCT)


def chunks(tokens: Column, n: int = CHUNK) -> Column:
    """Slices of n tokens; no tokens, no slice."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / n).cast("int")), lambda i: F.slice(tokens, i * n + 1, n))
    return F.when(F.size(tokens) > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def bound_chunks(tokens: Column, n: int = CHUNK) -> Column:
    """chunks of an expression: the outer transform binds the tokens, so that they
    are made once and not once a slice. Not for the input of a Python function,
    where such an expression isn't evaluated."""
    return F.get(F.transform(F.array(tokens), lambda t: chunks(t, n)), F.lit(0))
