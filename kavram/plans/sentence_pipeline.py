"""The sentence pipeline: TSV in, annotated table out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..models.serve import Assets, annotated, resolve
from ..operators import sentence_table as S
from ..sources import tsv

KEYS = ["t_code", "ch_no", "p_no", "s_no"]


def annotate(df: DataFrame, models: dict[str, str], assets: Assets = Assets()) -> DataFrame:
    """Prepared sentences with sentiment, morph, lemma, pos, ner and dep, as far as the models are chosen."""
    out = annotated(S.by_length(df), models, assets)
    if "stemmer" in models:
        out = out.withColumn("lemma", S.lemmas(F.col("morph")))
    for model in ("pos", "ner"):
        if model in models:
            out = out.withColumn(model, S.tags(F.col(model)))
    if "dep" in models:
        out = out.withColumn("dep", S.heads(F.col("dep")))
    order = ["sentiment", "morph", "lemma", "pos", "ner", "dep"]
    return out.select(*df.columns, *[c for c in order if c in out.columns])


@dataclass
class Report:
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else float("inf")


class Pipeline:
    """models: names, or ``name:variant``; what they need is added."""

    def __init__(self, models: list[str], assets: Assets = Assets()):
        self.models, self.assets = resolve(models), assets

    def run(self, spark: SparkSession, path: str, output: str, batch_size: int = 32, checkpoint: str | None = None) -> DataFrame:
        """Reads the TSV, writes the raw rows beside the output, and the annotated table to it.
        ``report`` then has rows and time of the annotation."""
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(setting)
        spark.conf.set(setting, str(batch_size))
        try:
            return self._run(spark, path, output, checkpoint)
        finally:
            spark.conf.set(setting, before)

    def _run(self, spark: SparkSession, path: str, output: str, checkpoint: str | None) -> DataFrame:
        raw = tsv.read_sentences(spark, path)
        raw.write.mode("overwrite").parquet(checkpoint or f"{output.rstrip('/')}.raw")
        seen = Observation()
        # put in order before the models: the sample that a sort takes would run them twice
        ready = S.prepared(raw).repartitionByRange(*KEYS)
        done = annotate(ready, self.models, self.assets).observe(seen, F.count(F.lit(1)).alias("rows"))
        began = time.monotonic()
        tsv.write_table(done.sortWithinPartitions(*KEYS), output)
        self.report = Report(seen.get["rows"], time.monotonic() - began)
        return spark.read.parquet(output)
