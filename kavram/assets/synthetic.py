"""Dictionaries and pattern tables of real size, made from the words of a corpus.

The analyser's and the deasciifier's own tables are the user's. To run these at
size without them, tables of any length are drawn from a corpus here: their
entries have nothing to do with a language, but they are met as often as real
ones are. Which entries are taken depends on hashes, so equal corpora give equal
tables; sizes are those of the tables, whatever the corpus has.
"""

from __future__ import annotations

from collections import Counter

import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.deasciify import Table
from ..functions.text import FLAGS
from ..operators.morphology import Dictionaries, lower

_TAGS = ("A3sg+Pnon+Nom", "A3sg+Pnon+Loc", "A3sg+Pnon+Acc", "A3pl+Pnon+Nom", "A3sg+P3sg+Nom", "A3sg+Pnon+Nom^DB+Noun+Agt+A3sg+Pnon+Nom")


def _draw(text: str, n: int) -> int:
    return xxhash.xxh64_intdigest(text) % n


def _sample(words: DataFrame, n: int) -> list[str]:
    """n of the distinct words, by hash."""
    some = words.select(F.col(words.columns[0]).alias("w")).where("length(w) between 2 and 30").distinct()
    return [r.w for r in some.orderBy(F.xxhash64("w"), "w").limit(n).collect()]


def dictionaries(words: DataFrame, stems: int = 20_000, suffixes: int = 400) -> Dictionaries:
    """words: one column. Stems are beginnings of words with one or two parts of speech, suffixes their most frequent ends with one to three tags."""
    sample = _sample(words, 2 * stems)
    ends = Counter(lower(w[-k:]) for w in sample for k in range(1, 5) if len(w) > k + 1)
    known = [s for s, _ in sorted(ends.items(), key=lambda x: (-x[1], x[0]))[:suffixes]]
    begins = dict.fromkeys(lower(w[: len(w) - _draw(w, 5)]) for w in sample if len(w) > 6 or _draw(w, 2))
    parts = {s: sorted({FLAGS[_draw(s, 12)], FLAGS[_draw(s + "2", 12)] if _draw(s, 3) else "Noun"}) for s in list(begins)[:stems]}
    tags = {s: sorted({f"{FLAGS[_draw(s + str(k), 12)]}+{_TAGS[_draw(s + str(k), len(_TAGS))]}" for k in range(1 + _draw(s, 3))} | {"Noun+" + _TAGS[_draw(s, 5)]}) for s in known}
    return Dictionaries(tags | {"null": sorted({f"{p}+{_TAGS[0]}" for p in FLAGS})}, parts)


def patterns(words: DataFrame, n: int = 10_000) -> Table:
    """Contexts of the six letters as they are met in words, with ranks of either sign."""
    seen: dict[str, Counter] = {c: Counter() for c in "cgosui"}
    for w in _sample(words, 20_000):
        plain = f" {lower(w)} "
        for at, ch in enumerate(plain):
            if ch in seen:
                for before, after in ((1, 0), (0, 1), (1, 1), (2, 1), (2, 2), (3, 2)):
                    if at >= before:
                        seen[ch][plain[at - before : at] + "X" + plain[at + 1 : at + 1 + after]] += 1
    out: Table = {}
    for ch, found in seen.items():
        best = [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: n // len(seen)]]
        out[ch] = {p: (i + 1) * (1 if _draw(ch + p, 3) == 0 else -1) for i, p in enumerate(sorted(best, key=lambda p: (-len(p), p)))}
    return out
