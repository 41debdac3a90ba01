"""Stop words: a fixed list, and those that a corpus itself gives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import assets


def read_words(spark: SparkSession, path: str) -> list[str]:
    """One word a line, ends trimmed."""
    rows = assets.lines(spark, path).select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("w")).where("w <> ''").distinct().collect()
    return sorted(r.w for r in rows)


def with_words(words: Iterable[str], more: Iterable[str]) -> list[str]:
    """A longer list; the given one stays as it is."""
    return sorted({*words, *more})


def drop(tokens: Column, words: Iterable[str]) -> Column:
    """Tokens that aren't in the list, in their order; case counts."""
    words = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def drop_rows(df: DataFrame, words: DataFrame, token: str = "token") -> DataFrame:
    """The same on a table with a row for each token, for lists of any size: words has one column, ``word``."""
    return df.join(words.select(F.col("word").alias(token)).distinct(), token, "left_anti")


def frequencies(df: DataFrame, token: str = "token") -> DataFrame:
    return df.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("cnt"))


def detected(counts: DataFrame, rare: int = 0) -> DataFrame:
    """(token, cnt, reason) of the stop words of a table (token, cnt).

    Counts are sorted from the largest; the relative change from each to the
    next is taken, and of these the relative change again. The words up to the
    largest second change, and one more, are ``frequent``. Changes 0/0 are left
    out before the largest is looked for; x/0 counts as infinite, the first of
    them wins. Words of at most ``rare`` are ``rare`` as well. Equal counts are
    ordered by token, descending. Fewer than three words, or no second change,
    give no frequent words.

    Equal counts make equal changes: the work is on distinct counts, of which a
    vocabulary of any size has few (at most as many as the square root of twice
    the number of tokens), so the one-partition windows stay small. Only words
    near the cut are ordered by name.
    """
    sizes = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("cnt").desc())
    # the words of one count lie side by side: places first..last, from 0
    placed = sizes.withColumn("last", F.sum("n").over(down) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    placed = placed.withColumn("c2", F.lead("cnt", 1).over(down)).withColumn("n2", F.lead("n", 1).over(down)).withColumn("c3", F.lead("cnt", 2).over(down))
    infinite = F.lit(float("inf"))
    step = lambda a, b: F.abs((b - a) / a.cast("double"))
    second = lambda p, q: F.when((p == 0) & (q == 0), F.lit(None)).when(p == 0, infinite).otherwise(F.abs((q - p) / F.when(p != 0, p)))
    here, there = step(F.col("cnt"), F.col("c2")), F.when(F.col("n2") > 1, 0.0).otherwise(step(F.col("c2"), F.col("c3")))
    # pairs of places whose second change isn't 0/0: (last-1, last, next) with n > 1, and (last, next, after)
    inner = F.when((F.col("n") > 1) & F.col("c2").isNotNull(), F.struct((F.col("last") - 1).alias("at"), second(F.lit(0.0), here).alias("v")))
    outer = F.when(F.col("c2").isNotNull() & ((F.col("n2") > 1) | F.col("c3").isNotNull()), F.struct(F.col("last").alias("at"), second(here, there).alias("v")))
    changes = placed.select(F.explode(F.array(inner, outer)).alias("x")).where("x is not null and x.v is not null").select("x.*")
    # the place among those left is what counts, not the place in the list
    ranked = changes.withColumn("k", F.row_number().over(Window.orderBy("at")) - 1)
    cut = ranked.orderBy(F.col("v").desc(), "k").limit(1).select((F.col("k") + 2).alias("size"))
    total = sizes.agg(F.sum("n").alias("total"))
    bound = placed.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(total)).where("total >= 3 and first < size").select("cnt", "first", "size")
    near = counts.join(bound, "cnt")  # Spark knows the size of the bound when it runs
    named = near.withColumn("r", F.col("first") + F.row_number().over(Window.partitionBy("cnt").orderBy(F.col("token").desc())) - 1)
    frequent = named.where("r < size").select("token", "cnt", F.lit("frequent").alias("reason"))
    return frequent.union(counts.where(F.col("cnt") <= rare).select("token", "cnt", F.lit("rare").alias("reason")))
