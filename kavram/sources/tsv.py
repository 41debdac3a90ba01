"""The sentence TSV: no header, five columns by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SCHEMA = T.StructType([T.StructField("t_code", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("ch_no", "p_no", "s_no")), T.StructField("sentence", T.StringType())])

#: Words that a data frame library reads as missing.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _fields(lines: DataFrame) -> DataFrame:
    """(value) cut at tabs, with the schema's names, all of them text; an empty field is null. Nothing quotes, nothing escapes."""
    parts = F.split("value", "\t")
    some = lines.where(F.col("value").rlike(r"[^\x00-\x20]"))
    return some.select(*[F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(SCHEMA.names)])


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint"))


def literal(lines: DataFrame) -> DataFrame:
    """Sentences of a table of lines (value), of a stream too. Blank lines are skipped."""
    fields = _fields(lines)
    return fields.select(*[_number(F.col(f.name)).alias(f.name) if f.dataType == T.LongType() else F.col(f.name) for f in SCHEMA])


def read_sentences(spark: SparkSession, path: str | list[str], na_words: bool = False, quotes: bool = False) -> DataFrame:
    """na_words: sentences that are NA words count as missing. quotes: a field in
    double quotes is unquoted; by default text is literal. Blank lines are skipped."""
    if quotes:
        raw = spark.read.csv(path, sep="\t", schema=SCHEMA, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        raw = literal(spark.read.text(path))
    if na_words:
        raw = raw.withColumn("sentence", F.when(~F.col("sentence").isin(*NA_WORDS), F.col("sentence")))
    return raw


def read_repaired(spark: SparkSession, path: str | list[str], suffix: str = "_sentence-split-corrected.csv") -> DataFrame:
    """Files whose rows have four columns get their t_code from the name of the file."""
    raw = _fields(spark.read.text(path))
    file = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    short = F.col("sentence").isNull() & F.col("s_no").isNotNull() & F.col("s_no").try_cast("bigint").isNull()
    names = SCHEMA.names
    moved = [F.when(short, file).otherwise(F.col(names[0])).alias(names[0])]
    for before, name in zip(names, names[1:]):
        value = F.when(short, F.col(before)).otherwise(F.col(name))
        moved.append((value if name == "sentence" else value.try_cast("bigint")).alias(name))
    return raw.select(*moved)


def write_lines(df: DataFrame, path: str) -> None:
    """Columns joined by tabs, as they are; null is empty. They must hold no tab and no line break."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])).write.text(path)


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Parquet, overwritten; sorted by the keys only here, where the order is seen."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(path)
