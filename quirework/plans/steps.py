"""Steps of a run that asks a provider: every table that more than one step reads, and every reply, is written below a path.

A retried task would ask again, and a plan over many steps would repeat all before it. Texts are not moved again: replies carry
their keys through the provider, and a table of texts lies in buckets, so that joins move the other side.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structured import repair_json
from ..provider import Provider, ask


class Run:
    """A provider and the folder of a run's tables."""

    def __init__(self, spark: SparkSession, provider: Provider, path: str):
        self.spark, self.provider, self.path, self.steps = spark, provider, path, 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.steps += 1
        at = f"{self.path}/{self.steps:03d}-{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def dealt(self, df: DataFrame, name: str, lies: bool = False) -> DataFrame:
        """df written in buckets by doc_id: a join by doc_id with `other.hint("shuffle_hash")` moves the other rows only.

        lies: df's rows lie by doc_id already, as after such a join. The table's name leaves the catalogue, its files stay below the path.
        """
        self.steps += 1
        n, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"run_{uuid.uuid4().hex}"
        rows = df if lies else df.repartition(n, "doc_id")
        rows.write.format("parquet").bucketBy(n, "doc_id").option("path", f"{self.path}/{self.steps:03d}-{name}").saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def asked(self, rows: DataFrame, prompt: str, inputs: dict[str, Column | str], keys: Sequence[str], json_mode: bool = True) -> DataFrame:
        """The columns `keys` of rows, `reply`, `reason`, and the reply's `json` in json_mode. rows are read once and need not be written."""
        pairs = [x for name, column in inputs.items() for x in (F.lit(name), F.col(column) if isinstance(column, str) else column)]
        held = {f"key_{k}": k for k in keys}
        requests = rows.select(*(F.col(k).alias(name) for name, k in held.items()), F.lit(prompt).alias("prompt"), F.create_map(*pairs).alias("inputs"))
        answers = ask(requests, self.provider, json_mode, list(held)).select(*(F.col(name).alias(k) for name, k in held.items()), F.col("text").alias("reply"), "reason")
        if json_mode:
            answers = answers.withColumn("json", repair_json("reply"))
        return self.written(answers, prompt)
