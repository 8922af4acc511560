"""Run metrics: model calls, stages, counters; conversations as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_metrics(calls: DataFrame, digits: int | None = 3) -> DataFrame:
    """model, n_calls, total_s, avg_s, n_errors, input_tokens, output_tokens, total_tokens of calls
    (model, seconds, error, input_tokens, output_tokens); null tokens count as 0."""
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    tokens = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")]
    out = calls.groupBy("model").agg(F.count("*").alias("n_calls"), F.sum("seconds").alias("s"), F.count_if("error").alias("n_errors"), *tokens)
    s = F.coalesce("s", F.lit(0.0))
    return out.select("model", "n_calls", rounded(s).alias("total_s"), rounded(s / F.col("n_calls")).alias("avg_s"), "n_errors", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def grand_totals(calls: DataFrame) -> DataFrame:
    """One row over all calls: n_calls, total_s, input_tokens, output_tokens."""
    return calls.agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_s"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))


def stage_durations(events: DataFrame) -> DataFrame:
    """run, stage, seconds: the last recorded duration (by seq) of each stage."""
    return events.groupBy("run", "stage").agg(F.max_by("seconds", "seq").alias("seconds"))


def stage_calls(events: DataFrame) -> DataFrame:
    """stage, n_calls, total_s, avg_s."""
    return events.groupBy("stage").agg(F.count("*").alias("n_calls"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("avg_s"))


def counters(events: DataFrame) -> DataFrame:
    """run, key, value: the last value of each counter."""
    return events.groupBy("run", "key").agg(F.max_by("value", "seq").alias("value"))


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, system (system texts joined by an empty line, null without), messages (the others in order)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = turns.groupBy("conv_id").agg(ordered.alias("m"))
    system = F.filter("m", lambda x: x["role"] == "system")
    rest = F.filter("m", lambda x: x["role"] != "system")
    return out.select("conv_id", F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda x: x["text"]), "\n\n")).alias("system"), F.transform(rest, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
