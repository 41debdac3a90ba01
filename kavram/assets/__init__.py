"""Small tables of this package's own; the user's replace them."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def path(name: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), name)


def lines(spark: SparkSession, where: str) -> DataFrame:
    """(value): the lines of a text file. One of the driver's machine is read there, as executors don't have it."""
    if not os.path.isfile(where):
        return spark.read.text(where)
    with open(where, encoding="utf-8") as f:
        return spark.createDataFrame([(x,) for x in f.read().split("\n") if x], "value string")


@lru_cache(maxsize=4)
def lexicon(where: str) -> frozenset[str]:
    """Known words, one a line, read when they are first asked for and kept by the process."""
    with open(where, encoding="utf-8") as f:
        return frozenset(w for w in map(str.strip, f) if w)
