"""The corpus pipeline: documents in, packed token rows out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kavram.llm import decontaminate, mixing, near_dedup, packing, quality_rules
from kavram.llm.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose character or word distribution diverges from their language go.

    Null, empty and short texts stay (a guard holds), and so do documents of a
    language with too few words to be a reference; a null language is one of its
    own. Texts are judged whole, repeated rows each by itself. Extra columns of any
    name are kept; an empty table gives an empty one."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id, null last.

    Of repeated rows one stays. Null and wordless texts always stay, repeated or
    not. Texts are compared whole. Extra columns of any name are kept; an empty
    table gives an empty one."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the test set go.

    Null and empty texts stay, and null and empty items are in no document. Texts
    are searched whole, repeated rows each by itself. Extra columns of any name are
    kept; an empty table of either kind changes nothing else."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are interleaved at their target weights; those with less than their weight repeat.

    Every row occurs once at least; a null source is one of its own. Ties are
    broken by the columns' hash, equal rows are interchangeable. Texts, null or of
    any length, aren't read. Extra columns of any name are kept; an empty table
    gives an empty one."""
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become rows of token ids, packed in the order of the mix.

    Null and empty texts are an end token, texts of any length are split into
    pieces without loss, and repeated rows are packed each. Null ids stay null.
    Only id and text are read; an empty table gives no rows."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("pack", pack),
]

#: Near-duplicate search by signatures and the tokenizer can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
