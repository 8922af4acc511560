"""Continuous ingestion: documents that arrive as files become pages and entity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.entities import entities
from ..operators.pages import pages_of


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def page_stream(docs: DataFrame) -> DataFrame:
    """Pages with their entities, without state, so it can run on batches and streams alike."""
    return pages_of(docs).withColumn("entities", entities("text"))


def start(stream: DataFrame, path: str, checkpoint: str):
    """Writes the pages as they come; each file is taken once. Ends when what is there has been read."""
    return page_stream(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
