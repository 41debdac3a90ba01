"""Sentence splitting as one built-in expression.

Four replacements put line breaks where marks alone decide. Then every word that
ends with dots is looked at with the word after it: abbreviations that a list
names, and acronyms, don't end a sentence; other words do if the next one begins
like a sentence. Line breaks of the input end sentences too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_OPEN = r"'\"(\[\x{BF}\x{A1}\p{Pi}"
_START = r"\p{Lu}\p{Lo}"
RULES = (
    rf"([?!]) +([{_OPEN}]*[{_START}])",
    rf"(\.[\.]+) +([{_OPEN}]*[{_START}])",
    rf"([?!\.][\ ]*['\")\]\p{{Pf}}]+) +([{_OPEN}]*[\ ]*[{_START}])",
    rf"([?!\.]) +(['\"\[\x{{BF}}\x{{A1}}\p{{Pi}}]+[\ ]*[{_START}])",
)
_ENDING = r"([\p{L}\p{N}\p{M}_.\-]*)(['\")\]%\p{Pf}]*)(\.+)(?=\n?\z)"
_ACRONYM = rf"\.[{_START}\-]+\.+(?=\n?\z)"
_BEGINS = rf"\A[ ]*[{_OPEN}]*[ ]*[{_START}0-9]"


@dataclass(frozen=True)
class Prefixes:
    """Abbreviations after which a sentence goes on: always, or only before a number."""

    always: tuple[str, ...] = ()
    before_number: tuple[str, ...] = ()


def parse_prefixes(lines: list[str]) -> Prefixes:
    """One abbreviation a line; # begins a comment, #NUMERIC_ONLY# marks those of the second kind. A later line wins."""
    kinds: dict[str, bool] = {}
    for line in lines:
        word = line.partition("#")[0].strip()
        if word:
            kinds[word] = "#NUMERIC_ONLY#" in line
    return Prefixes(tuple(w for w, n in kinds.items() if not n), tuple(w for w, n in kinds.items() if n))


def break_marks(c: Column) -> Column:
    """The four rules that need no list."""
    for rule in RULES:
        c = F.regexp_replace(c, F.lit(rule), F.lit("$1\n$2"))
    return c


def split_sentences(c: Column, prefixes: Prefixes = Prefixes()) -> Column:
    def ends(word: Column, following: Column) -> Column:
        prefix, closing = F.regexp_extract(word, _ENDING, 1), F.regexp_extract(word, _ENDING, 2)
        bare = closing == ""
        stays = bare & prefix.isin(*prefixes.always) if prefixes.always else F.lit(False)
        number = bare & prefix.isin(*prefixes.before_number) & following.rlike(r"\A[0-9]") if prefixes.before_number else F.lit(False)
        dots = word.endswith(".") | word.endswith(".\n")  # as the patterns below need; few words do
        return following.isNotNull() & dots & word.rlike(_ENDING) & ~stays & ~word.rlike(_ACRONYM) & following.rlike(_BEGINS) & ~number

    def marked(words: Column) -> Column:
        following = F.slice(words, F.lit(2), F.size(words))  # one shorter: the last word is followed by null
        return F.zip_with(words, following, lambda w, n: F.when(ends(w, n), F.concat(w, F.lit("\n"))).otherwise(w))

    words = F.split(break_marks(c), " +")
    # the outer transform binds the words, so that they are split once
    text = F.array_join(F.get(F.transform(F.array(words), marked), F.lit(0)), " ")
    for have, want in ((" +", " "), ("\n ", "\n"), (" \n", "\n")):
        text = F.regexp_replace(text, F.lit(have), F.lit(want))
    text = F.regexp_replace(text, F.lit(r"\A[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+\z"), F.lit(""))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
