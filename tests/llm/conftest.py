from __future__ import annotations

import random
import re

import pytest

#: The documents' columns, and others named like what the operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, rid string, slot int, `band` string, goes string, place int, t string, i int, epoch string, mix_key string"

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text[, lang[, source]])."""

    def table(rows, parts=3):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, "en", "a")[:4] if len(r) == 2 else (*r, "a")[:4]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, False, "r", 1, "b", "g", 2, "t", 3, "e", "k"))
        return spark.createDataFrame(full, COLUMNS).repartition(parts) if full else spark.createDataFrame([], COLUMNS)

    return table


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    some = prose(rng, 120)
    return [
        (1, some, "en", "a"),
        (1, some, "en", "a"),
        (2, some, "en", None),
        (None, some, "en", "b"),
        (None, None, None, None),
        (3, None, "en", "b"),
        (4, "", "en", "b"),
        (4, "", "en", "b"),
        (5, " \n\t ", None, "b"),
        (6, "one", "xx", "c"),
        (7, long, "en", "a"),
        (8, "x" * 100_000, "en", "c"),
        (9, "Ünïcode ßtraße \U0001f600 日本語     end", "de", "c"),
        (10, "!!! ??? ...", "en", "c"),
    ]
