"""Numbers as Turkish words.

``integer_words`` is a built-in expression for whole-number columns. Free tokens,
with separators, exponents and decimals, go through ``number_words``, an Arrow
UDF, because their reading is that of floating-point text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

SCALES = ("", "bin", "milyon", "milyar", "trilyon", "katrilyon")
UNITS = ("", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz")
TENS = ("", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan")
#: Scales of the older reader, which goes on where the newer one ends.
LEGACY_SCALES = SCALES + ("kentilyon", "seksilyon", "septilyon", "oktilyon", "nonilyon", "desilyon", "undesilyon", "dodesilyon", "tredesilyon", "katordesilyon", "seksdesilyon", "septendesilyon", "oktodesilyon", "novemdesilyon", "vigintilyon")


def integer_words(c: Column) -> Column:
    """Words of a whole number below 10**18; null beyond."""
    n = F.abs(F.when(F.abs(c.cast("decimal(38,0)")) < 10**18, c).cast("bigint"))
    units, tens, parts = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS)), []
    for k in range(len(SCALES) - 1, -1, -1):
        group = F.call_function("div", n, F.lit(1000**k)) % 1000
        hundreds, ten, unit = (F.call_function("div", group, F.lit(d)).cast("int") % 10 for d in (100, 10, 1))
        words = [F.when(hundreds > 1, F.get(units, hundreds)), F.when(hundreds > 0, F.lit("yüz")), F.get(tens, ten)]
        words.append(F.when((group == 1), F.lit("")).otherwise(F.get(units, unit)) if k == 1 else F.get(units, unit))
        words.append(F.when(group > 0, F.lit(SCALES[k])))
        parts += words
    filled = F.array_join(F.filter(F.array(*parts), lambda w: w.isNotNull() & (w != "")), " ")
    signed = F.when(n == 0, F.lit("sıfır")).when(c < 0, F.concat(F.lit("eksi "), filled)).otherwise(filled)
    return F.when(n.isNotNull(), signed)


def int_words(n: int, scales: tuple[str, ...] = SCALES) -> str:
    if n == 0:
        return "sıfır"
    if n < 0:
        return "eksi " + int_words(-n, scales)
    words: list[str] = []
    groups = []
    while n:
        n, group = divmod(n, 1000)
        groups.append(group)
    for k in range(len(groups) - 1, -1, -1):
        group = groups[k]
        if not group:
            continue
        hundreds, ten, unit = group // 100, group // 10 % 10, group % 10
        if hundreds:
            words += [UNITS[hundreds], "yüz"] if hundreds > 1 else ["yüz"]
        words.append(TENS[ten])
        if not (k == 1 and group == 1):
            words.append(UNITS[unit])
        words.append(scales[k])
    return " ".join(w for w in words if w)


def number_token(token: str, digits: int = 6, separator: str = ",", legacy: bool = False) -> list[str]:
    """Words of a token that is a number, else the token alone. Numbers that have
    no words (infinite, not a number, too large) stay tokens."""
    text = token
    scales = LEGACY_SCALES if legacy else SCALES
    if any(ch.isnumeric() for ch in token):
        other = "_" if legacy else ""
        if separator == ",":
            text = text.replace(".", other).replace(",", ".")
        elif separator == ".":
            text = text.replace(",", other)
        else:
            raise ValueError(f"{separator!r} is no decimal separator; use '.' or ','")
    kept = text if legacy else token
    try:
        value = float(text)
    except ValueError:
        return [kept]
    if value != value or abs(value) >= 1000.0 ** len(scales):
        return [kept]
    whole = int(value)
    words = int_words(whole, scales)
    if abs(value - whole) >= 10**-digits:
        decimals = f"{value:.{digits}f}".split(".")[1].rstrip("0")
        if decimals:
            words += " virgül " + int_words(int(decimals), scales)
    return words.split()


#: A token without a digit is a number only as one of these words.
_NUMERIC = r"\p{N}|(?i)\A[+-]?(?:nan|inf|infinity)\z"


def _checked(separator: str) -> None:
    if separator not in ",.":
        raise ValueError(f"{separator!r} is no decimal separator; use '.' or ','")


def number_words_udf(digits: int = 6, separator: str = ",", legacy: bool = False):
    """array<string> to array<string>, for SQL."""
    _checked(separator)

    @F.pandas_udf("array<string>")
    def convert(batch: pd.Series) -> pd.Series:
        return batch.map(lambda row: [w for t in row for w in number_token(t, digits, separator, legacy)] if row is not None else [])

    return convert


def number_words(tokens: Column, digits: int = 6, separator: str = ",", legacy: bool = False) -> Column:
    """Tokens with the numbers among them replaced by their words. Only those that
    can be numbers go through Python, the others' places are null on the way."""
    _checked(separator)

    @F.pandas_udf("array<array<string>>")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = lru_cache(maxsize=1 << 18)(lambda token: number_token(token, digits, separator, legacy))
        for batch in batches:
            yield batch.map(lambda row: [None if t is None else words(t) for t in row])

    plain = F.coalesce(tokens, F.array().cast("array<string>"))
    asked = F.transform(plain, lambda t: F.when(t.rlike(_NUMERIC), t))
    return F.flatten(F.zip_with(plain, said(asked), lambda t, w: F.coalesce(w, F.array(t))))
