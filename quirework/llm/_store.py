"""Shared-folder tables: lineage is cut with Parquet in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; `df.inputFiles()` and `discard` know the path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables written by `keep` that nothing reads any more; others are left alone."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_kept_at", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
