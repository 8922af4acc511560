"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight; a target stops at MOST times the source's own words and
the excess goes to the others by weight. A document's expected number of copies is target / source words, the
same within a source: its whole part is certain, its fraction is rounded by the pivotal method, which pairs
two documents' probabilities and moves mass between them at random until one becomes 0 or 1. The sum of
probabilities stays, so copies are exact to one document; documents meet in order of size, so words stay near
the target as well, since what one loses another of about its size gains.

Reduction tree: rows are dealt by source, size class and digest into groups of about GROUP_ROWS; each
group leaves at most one document with a residual probability. The residuals of a source meet FAN at a time in
the next round, until one is left; it is rounded by its own draw. Rounds grow with the logarithm of the rows.
Draws are digests of seed, round and doc_id, so reruns agree however rows are dealt to tasks.

Null source is a source, ordered last. Null or wordless text has size 0 and is taken as often as it is copied,
0 words each. Rows with equal doc_id are rounded one by one; equal rows are interchangeable. Of a source
without words the target is 0. A text is counted as a whole by one task, however long. An empty table gives an empty one.
Other columns than doc_id, source and text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, keep
from ._text import SPACED, U, mix, slices, whole_groups, words

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
GROUP_ROWS = 4096
FAN = 256


def targets(sizes: Sequence[float], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Words wanted of each source: all words by weight, at most `most` times what it has, the excess reshared."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest_ of the text and size_ (words) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.zeros(0, np.int64)]
            for _, _, data, offs in slices(batch.column(2)):
                n.append(np.diff(words(data, offs, SPACED, hashed=False)[3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.concatenate(n).astype(np.int64))], ["doc_id", "source", "digest_", "size_"])

    rows = docs.select("doc_id", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest_"))
    s = docs.schema
    return rows.mapInArrow(count, f"doc_id {s['doc_id'].dataType.simpleString()}, source {s['source'].dataType.simpleString()}, digest_ long, size_ long")


def _pivot(p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds probabilities (strictly between 0 and 1) in their order; at most one, at the place returned, stays open (else -1)."""
    p, held = p.tolist(), -1
    draw = draw.tolist()
    for i in range(len(p)):
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        s = a + b
        if s < 1:  # one of the two falls to 0
            if draw[i] * s < b:
                p[held], p[i], held = 0.0, s, i
            else:
                p[held], p[i] = s, 0.0
        else:  # one of the two rises to 1
            if draw[i] * (2 - s) < 1 - b:
                p[held], p[i], held = 1.0, s - 1, i
            else:
                p[held], p[i] = s - 1, 1.0
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held] = round(p[held])
            held = -1
    return np.array(p), held


def _draws(key: np.ndarray, seed: int, level: int) -> np.ndarray:
    salt = U((0x9E3779B97F4A7C15 * (seed * 64 + level + 1)) % (1 << 64))
    return (mix(key.view(U) ^ salt) >> U(11)).astype(np.float64) / float(1 << 53)


def _rounded(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """One level of the tree: group_, key_, size_, p_ -> the same, p_ rounded but for one row a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["group_"]):
            group, p = t.column("group_").to_numpy(), t.column("p_").to_numpy().copy()
            draw = _draws(t.column("key_").to_numpy(), seed, level)
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                p[a:b] = _pivot(p[a:b], draw[a:b])[0]
            yield from t.set_column(t.schema.get_field_index("p_"), "p_", pa.array(p)).to_batches()

    dealt = rows.repartition("group_").sortWithinPartitions("group_", "size_", "key_")
    return dealt.mapInArrow(run, rows.schema)


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 0, group_rows: int = GROUP_ROWS, tables: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, source, digest_, size_, source_size_, target_ and copies_ of every row of docs; the kept tables it reads are added to `tables`."""
    spark, tables = docs.sparkSession, [] if tables is None else tables
    counted = keep(_word_counts(docs), "sizes")
    tables.append(counted)
    # one row for each source: a table of at most as many rows as there are sources, which the weights speak of
    per = [(r.source, int(r.s or 0), r.n) for r in counted.groupBy("source").agg(F.sum("size_").alias("s"), F.count("*").alias("n")).collect()]
    per.sort(key=lambda r: (r[0] is None, str(r[0] if r[0] is not None else "").encode("utf-32-be")))
    wanted = targets([s for _, s, _ in per], [weights[i % len(weights)] for i in range(len(per))], most)
    table = [(i, name, s, float(t), t / s if s else 0.0, max(1, n // group_rows)) for i, ((name, s, n), t) in enumerate(zip(per, wanted, strict=True))]
    kind = docs.schema["source"].dataType.simpleString()
    plan = spark.createDataFrame(table, f"stratum_ long, source_of_ {kind}, source_size_ long, target_ double, rate_ double, groups_ long")
    rows = counted.join(plan, counted["source"].eqNullSafe(plan["source_of_"])).drop("source_of_")
    rows = rows.withColumn("whole_", F.floor("rate_")).withColumn("p_", F.col("rate_") - F.floor("rate_"))
    rows = rows.withColumn("key_", F.xxhash64(F.lit(seed), "doc_id", "digest_"))
    if not table:
        return rows.select("doc_id", "source", "digest_", "size_", "source_size_", "target_", F.lit(0).cast("long").alias("copies_"))
    # sizes fall into classes of a quarter of a binary power; big groups of a class are dealt on by digest
    size_class = F.floor(4 * F.log2(F.col("size_") + 1.0))
    spread = F.pmod(F.col("key_"), F.greatest(F.lit(1), F.col("groups_") / 8).cast("long"))
    rows = rows.withColumn("group_", (F.col("stratum_") * 256 + size_class) * (1 << 32) + spread)
    open_, done = rows.filter(F.col("p_").between(1e-12, 1 - 1e-12)), rows.filter(~F.col("p_").between(1e-12, 1 - 1e-12))
    cols = ["doc_id", "source", "digest_", "size_", "source_size_", "target_", "whole_", "p_", "key_", "group_", "stratum_"]
    done = done.select(*cols).withColumn("p_", F.round("p_"))
    current, parts, level = open_.select(*cols), [done], 0
    while True:
        level += 1
        out = keep(_rounded(current, seed, level), f"pivot{level}")
        tables.append(out)
        settled = F.col("p_").isin(0.0, 1.0)
        parts.append(out.filter(settled))
        current = out.filter(~settled)
        n = current.groupBy("stratum_").count().agg(F.max("count")).first()[0] or 0
        if n <= 1:
            # a source's last probability is rounded by its own draw
            draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "key_"), F.lit(1 << 32)) / float(1 << 32)
            parts.append(current.withColumn("p_", F.when(draw < F.col("p_"), 1.0).otherwise(0.0)))
            break
        # residuals meet in order of size class, FAN groups at a time, so those of about one size come together
        w = Window.partitionBy("stratum_").orderBy("group_", "key_")
        current = current.withColumn("group_", F.col("stratum_") * (1 << 32) + F.floor(F.row_number().over(w) / FAN)) if n <= FAN * FAN else current.withColumn("group_", F.col("stratum_") * (1 << 32) + F.pmod(F.xxhash64("group_"), F.lit(n // FAN)))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result.select("doc_id", "source", "digest_", "size_", "source_size_", "target_", (F.col("whole_") + F.col("p_")).cast("long").alias("copies_"))


def allot(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies), source and copies of every row."""
    out = copies(docs, weights, most, seed)
    return out.select("doc_id", F.col("size_").alias("size"), F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), (F.col("size_") * F.col("copies_")).alias("taken"), "source", F.col("copies_").alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """docs with each row repeated as often as the mix copies it, its columns unchanged, whatever their names."""
    key = [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")).alias("id_"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z")).alias("of_"),
    ]
    same = ["id_", "of_", "digest_"]
    tables: list[DataFrame] = []
    chosen = copies(docs.select("doc_id", "source", "text"), weights, most, seed, tables=tables).select(*key, "digest_", "copies_")
    # rows equal in doc_id, source and text are interchangeable: they share the sum of their copies
    totals = keep(chosen.groupBy(*same).agg(F.sum("copies_").alias("copies_"), F.count("*").alias("rows_")).filter("copies_ > 0"), "copies")
    discard(*tables)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), *key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest_")).join(totals, same)
    # of `rows_` equal rows the first `copies_ mod rows_` get one copy more
    spread = F.when(F.col("rows_") == 1, F.col("copies_")).otherwise(F.expr("(copies_ + rows_ - row_number() over (partition by id_, of_, digest_ order by id_)) div rows_"))
    taken = rows.withColumn("taken_", spread).filter("taken_ > 0")
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("taken_").cast("int")))).select("row_.*")
