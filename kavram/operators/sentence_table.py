"""Relational operators on the sentence table.

Keys are explicit: a row is known by its key columns and a token by its place, so
nothing depends on the order in which rows happen to lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, tokenize as K


def cleaned(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """White space collapsed; rows without text go."""
    return df.withColumn(sentence, T.clean(F.col(sentence))).filter(F.length(sentence) > 0)


def prepared(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """cleaned, with no_accents, tokens and tokens_40."""
    out = cleaned(df, sentence).withColumn("no_accents", T.remove_accents(F.col(sentence)))
    return out.withColumn("tokens", K.treebank(F.col("no_accents"))).withColumn("tokens_40", K.chunks(F.col("tokens")))


def by_length(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Rows of similar length side by side within each partition, which keeps the models' padding small; no shuffle."""
    return df.sortWithinPartitions(F.size(tokens))


def exploded(df: DataFrame, nested: str = "tokens_40", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, chunk_no, chunk): a row for each chunk. Rows without chunks have none."""
    return df.select(*keys, F.posexplode(nested).alias("chunk_no", "chunk"))


def imploded(df: DataFrame, value: str, place: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lists put together again in the order of their places."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(pairs, lambda x: x.v)).alias(value))


def lemmas(morph: Column) -> Column:
    """The part before the first plus of every analysis; those without plus are left out."""
    return F.coalesce(F.transform(F.filter(morph, lambda m: m.contains("+")), lambda m: F.substring_index(m, "+", 1)), F.array().cast("array<string>"))


def tags(pairs: Column) -> Column:
    """The tags of (token, tag) pairs."""
    return F.coalesce(F.transform(pairs, lambda x: x.tag), F.array().cast("array<string>"))


def heads(dep: Column) -> Column:
    """(head, rel) of (id, word, head, rel)."""
    return F.coalesce(F.transform(dep, lambda x: F.struct(x.head.alias("head"), x.rel.alias("rel"))), F.array().cast("array<struct<head:int,rel:string>>"))


def global_heads(nested: Column, n: int = K.CHUNK) -> Column:
    """Heads counted in the sentence rather than in their chunk; 0 stays the root."""
    return F.flatten(F.transform(nested, lambda chunk, i: F.transform(chunk, lambda x: F.struct(F.when(x.head > 0, x.head + i * n).otherwise(x.head).alias("head"), x.rel.alias("rel")))))


def with_annotations(df: DataFrame, annotations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join on the keys: every sentence stays."""
    return df.join(annotations, list(keys), "left")


def context(df: DataFrame, token: str, place: str, keys: tuple[str, ...], n: int = K.CHUNK) -> DataFrame:
    """left_ctx and right_ctx: up to n tokens either side of every token, joined by spaces."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(place)
    return df.withColumn("left_ctx", F.array_join(F.collect_list(token).over(w.rowsBetween(-n, -1)), " ")).withColumn("right_ctx", F.array_join(F.collect_list(token).over(w.rowsBetween(1, n)), " "))


def dep_arcs(dep: Column) -> Column:
    """Arcs for display: 0-based, start before end, the root's without arc."""
    some = F.filter(dep, lambda x: x.head > 0)

    def arc(x: Column) -> Column:
        start, end = x.id - 1, x.head - 1
        return F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), x.rel.alias("label"), F.when(start > end, "left").otherwise("right").alias("dir"))

    return F.transform(some, arc)


def dep_display(dep: Column, pos: Column | None = None) -> Column:
    """One document (words, arcs). Tags are X where the tagger's tokens differ from the parser's."""
    unknown = F.transform(dep, lambda x: F.struct(x.word.alias("text"), F.lit("X").alias("tag")))
    words = unknown
    if pos is not None:
        same = F.transform(pos, lambda x: x.token) == F.transform(dep, lambda x: x.word)
        words = F.when(same, F.transform(pos, lambda x: F.struct(x.token.alias("text"), x.tag.alias("tag")))).otherwise(unknown)
    return F.array(F.struct(words.alias("words"), dep_arcs(dep).alias("arcs")))


def ner_display(text: Column, ner: Column) -> Column:
    """(text, ents, title): spans of neighbouring tokens of one label.

    A fold over the tokens: each is searched from the end of the one before it,
    those that aren't found are passed over, and an entity goes on while its
    label does."""
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("last"),
        F.lit("O").alias("label"),
        F.lit(0).alias("begin"),
        F.array().cast("array<struct<start:int,end:int,label:string>>").alias("ents"),
    )

    def closed(s: Column) -> Column:
        one = F.array(F.struct(s["begin"].alias("start"), s["last"].alias("end"), s["label"].alias("label")))
        return F.when(s["label"] == "O", s["ents"]).otherwise(F.concat(s["ents"], one))

    def step(s: Column, x: Column) -> Column:
        place = F.position(x["token"], text, s["at"] + 1)
        begin, end = place - 1, place - 1 + F.length(x["token"])
        same = x["tag"] == s["label"]
        after = F.struct(
            end.alias("at"),
            end.alias("last"),
            x["tag"].alias("label"),
            F.when(same & (x["tag"] != "O"), s["begin"]).otherwise(begin).alias("begin"),
            F.when(same, s["ents"]).otherwise(closed(s)).alias("ents"),
        )
        return F.when(place > 0, after).otherwise(s)

    ents = F.aggregate(ner, start, step, closed)
    return F.struct(text.alias("text"), F.coalesce(ents, F.array().cast("array<struct<start:int,end:int,label:string>>")).alias("ents"), F.lit(None).cast("string").alias("title"))


def lowest_mode(labels: Column) -> Column:
    """The most frequent of an array of whole numbers, the lowest of several; 0 of none."""
    counted = F.transform(F.array_distinct(labels), lambda v: F.struct((-F.size(F.filter(labels, lambda y: y == v))).alias("n"), v.alias("v")))
    return F.coalesce(F.array_min(counted)["v"], F.lit(0))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def decode_arc(values: Column, n: int = K.CHUNK) -> Column:
    """(arc, label) of a parser's output vector: two argmaxes, without any tree constraint."""
    return F.struct(argmax(F.slice(values, 1, n + 1)).alias("arc"), argmax(F.slice(values, F.lit(n + 2), F.size(values))).alias("label"))


def positive(p: Column) -> Column:
    """1 above a probability of a half, else 0."""
    return F.when(p > 0.5, 1).otherwise(0)
