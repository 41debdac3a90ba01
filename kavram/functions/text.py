"""Column functions on text: cleaning, Turkish case, accents, punctuation, letters.

All are built-in expressions, so they stay inside whole-stage code. A null text
gives an empty text, as the sentence table has no null sentences after cleaning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Unicode defines it, and the four ASCII separators.
WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"

_UPPER, _LOWER = "İIĞÜÖŞÇ", "iığüöşç"
_ACCENTED, _PLAIN = "âôîêûÂÔÎÊÛ", "aoieuAOİEU"
_TURKISH, _ASCII = "İÇĞÜŞÖıçğüşö", "ICGUSOicguso"


def clean(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.coalesce(F.trim(F.regexp_replace(c, F.lit(WHITE + "+"), F.lit(" "))), F.lit(""))


def lower_tr(c: Column) -> Column:
    """Lower case where dotted and dotless i stay different letters."""
    return F.coalesce(F.lower(F.translate(c, _UPPER, _LOWER)), F.lit(""))


def remove_accents(c: Column) -> Column:
    """Circumflexes go; a capital I with circumflex becomes the dotted capital."""
    return F.coalesce(F.translate(c, _ACCENTED, _PLAIN), F.lit(""))


def strip_punctuation(c: Column) -> Column:
    """Letters, numbers and plain spaces stay."""
    return F.coalesce(F.regexp_replace(c, F.lit(r"[^\p{L}\p{N} ]"), F.lit("")), F.lit(""))


def asciify(c: Column) -> Column:
    return F.coalesce(F.translate(c, _TURKISH, _ASCII), F.lit(""))


def capitalize_tr(c: Column) -> Column:
    """First letter as an ASCII capital, the rest in lower case; one letter stays as it is."""
    first = F.upper(F.translate(F.substring(c, 1, 1), _TURKISH, _ASCII))
    return F.coalesce(F.when(F.length(c) > 1, F.concat(first, lower_tr(c.substr(F.lit(2), F.length(c))))).otherwise(c), F.lit(""))


def digits_to_zero(c: Column) -> Column:
    """Every numeric character becomes 0."""
    return F.coalesce(F.regexp_replace(c, F.lit(r"\p{N}"), F.lit("0")), F.lit(""))


def preprocess_word(c: Column) -> Column:
    """The word form of the older taggers: straight apostrophe, lower case, zeros."""
    return digits_to_zero(lower_tr(F.replace(c, F.lit("’"), F.lit("'"))))


def soften(c: Column) -> Column:
    """The hard counterpart of a soft final consonant: kitab- to kitap."""
    last = F.translate(F.right(c, F.lit(1)), "bBcCdDğĞgG", "pPçÇtTkKkK")
    return F.coalesce(F.when(F.length(c) > 0, F.concat(F.substring(c, F.lit(1), F.length(c) - 1), last)).otherwise(c), F.lit(""))


_ROOTS = {"tıp": "tıb", "prof.": "profesör", "dr.": "doktor", "yi": "ye", "ed": "et", "di": "de"}


def transform_root(c: Column) -> Column:
    """Irregular roots in the form of the stem list."""
    out = c
    for have, want in _ROOTS.items():
        out = F.when(c == have, F.lit(want)).otherwise(out)
    return out


def normalize_suffix(c: Column) -> Column:
    """Vowel harmony undone: a, e to A and ı, i, u, ü to H."""
    return F.translate(lower_tr(c), "aeıiuü", "AAHHHH")


FLAGS = ("Adj", "Adverb", "Conj", "Det", "Dup", "Interj", "Noun", "Postp", "Pron", "Ques", "Verb", "Num", "Noun+Prop")


def decode_flags(c: Column) -> Column:
    """Parts of speech of a 13-bit stem flag, the highest bit first; null if other bits are set."""
    bits = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(FLAGS[i]).alias("name")) for i in range(12, -1, -1)])
    names = F.transform(F.filter(bits, lambda b: c.bitwiseAND(b["bit"]) != 0), lambda b: b["name"])
    return F.when((c >= 0) & (c < 1 << 13), names)
