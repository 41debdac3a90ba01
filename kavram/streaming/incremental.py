"""New files only: a file stream that runs until it has caught up, then ends.

The checkpoint knows which files are done; a batch that is repeated after a
failure overwrites its own output, so every file is in the table once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import tsv


def process_new_files(spark: SparkSession, folder: str, output: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 64) -> None:
    """step is applied to the rows of files that weren't there before; results go to output, partitioned by batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    source = tsv.literal(lines).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))

    def sink(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
