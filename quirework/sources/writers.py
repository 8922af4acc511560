"""Sinks: trees as JSON, results by model, idempotent assets, run logs, comparison pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structured import render_kind, render_table
from ..functions.text import escape_html, linear_rows


def write_trees(trees: DataFrame, path: str) -> None:
    """doc_id, tree: one folder `doc_id=<id>` with the JSON text for each document."""
    trees.select("doc_id", F.col("tree").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the table at path lacks; returns how many were added."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def write_results(results: DataFrame, path: str) -> None:
    """name, text, model: results below `model=<model>`."""
    results.select("model", F.to_json(F.struct("name", "text")).alias("value")).write.mode("overwrite").partitionBy("model").text(path)


def write_regions(regions: DataFrame, path: str) -> None:
    """Regions below `kind=text` and `kind=non_text`."""
    regions.write.mode("overwrite").partitionBy("kind").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Run events as JSON lines, added to those there."""
    events.write.mode("append").json(path)


def comparison(groups: DataFrame) -> DataFrame:
    """pdf_stem, page, img, html: the members (name, model, task, text) of a group side by side."""
    rows = F.col("text")
    shown = F.when(render_kind(rows) == "table", render_table(linear_rows(rows))).when(render_kind(rows) == "blocks", rows).otherwise(F.concat(F.lit("<pre>"), escape_html(rows), F.lit("</pre>")))
    cell = F.concat(F.lit("<section><h3>"), escape_html("model"), F.lit(" "), escape_html("task"), F.lit("</h3>"), shown, F.lit("</section>"))
    parts = groups.withColumn("cell", cell).groupBy("pdf_stem", "page", "img").agg(F.array_sort(F.collect_list(F.struct("name", "cell"))).alias("c"))
    return parts.select("pdf_stem", "page", "img", F.array_join(F.transform("c", lambda x: x["cell"]), "\n").alias("html"))
