"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PLACE = "_written_to"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset (tests, one
    machine) a folder of this machine is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, whatever executor is lost later."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PLACE, path)
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(table, _PLACE))
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
