"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its letters' byte n-grams (2 to 4 bytes) and whole words, hashed into BUCKETS rows of an
embedding table; a text is the average of its features' rows, classified by a linear softmax. Both are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows: SAMPLE_ROWS for each
label, those with the smallest digests. A quarter of them is kept from training and calibrates the model:
a temperature for its probabilities, and the threshold under which a text is rejected (the CALIBRATED_LOSS
quantile of the true label's probability there, at most MOST_THRESHOLD). Prediction covers whole texts.

Since averaging and the linear layer commute, prediction looks up class scores (table times weights), so its cost
does not depend on the embedding's width.

`und` with score 0 is predicted for null text and text without a letter; it is always rejected. If no label can
be learned, every text is `und`. Rows with null doc_id are not learned from and not held out. Equal rows count once in the
sample. One task holds a text as a whole, however long. Of an empty table nothing is learned, and its result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import BASE, INVERSE, U, _power, mix, slices

BUCKETS = 1 << 16
WIDTH = 16
SAMPLE_ROWS = 500
EPOCHS, RATE = 6, 8.0
CALIBRATED_LOSS, MOST_THRESHOLD = 0.001, 0.5
ORDERS = (2, 3, 4)

#: byte -> lower-case letter byte; everything that is no letter in ASCII is a space
LUT = np.full(256, 32, np.uint8)
LUT[97:123] = np.arange(97, 123)
LUT[65:91] = np.arange(97, 123)
LUT[128:] = np.arange(128, 256)


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) arrays, one pair for each kind of feature; place: a byte of the row it belongs to, ascending."""
    low = LUT[data]
    n = len(low)
    limit = np.repeat(offs[1:], np.diff(offs))
    wide = low.astype(np.uint32)
    code = wide.copy()
    for k in range(1, max(ORDERS)):
        code = code[: n - k] * np.uint32(0x01000193) + wide[k:] if n > k else code[:0]
        if k + 1 in ORDERS:
            m = len(code)
            at = np.flatnonzero((np.arange(m) + k < limit[:m]) & ((low[:m] != 32) | (low[1 : m + 1] != 32)))
            h = code[at] * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA77 % (1 << 32))
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64), at
    inside = low != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[:-1][offs[:-1] < n]
    first[edge] = inside[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1

    total = np.zeros(n + 1, U)
    np.cumsum(low * _power(BASE, n), dtype=U, out=total[1:])
    yield (mix((total[ends] - total[starts]) * _power(INVERSE, n + 1)[starts]) >> U(48)).astype(np.int64), starts


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether a row has a Unicode letter."""
    ascii_letter = (LUT[data] != 32) & (data < 128)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = np.diff(total[offs]) > 0
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for r in np.flatnonzero(~out & (np.diff(wide[offs]) > 0)):
        out[r] = any(c.isalpha() for c in data[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """labels, class scores of every bucket, bias, temperature and threshold."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray):
        self.labels, self.table, self.bias, self.temperature, self.threshold = labels, table.astype(np.float32), bias.astype(np.float64), 1.0, 0.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(offs) - 1, len(self.labels))), np.zeros(len(offs) - 1)
        for bucket, place in features(data, offs):
            at = np.searchsorted(place, offs)
            n = np.diff(at)
            some = np.flatnonzero(n)
            count += n
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], at[:-1][some], axis=0, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], labels: list[str], seed: int = 0) -> Model:
    """samples: (label number, distinct buckets, share of each in the text)."""
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(labels))), np.zeros(len(labels))
    order, steps, step = np.arange(len(samples)), max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            y, buckets, share = samples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ table[buckets]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = weights @ p
            weights -= rate * 0.05 * np.outer(hidden, p)
            bias -= rate * 0.01 * p
            table[buckets] -= rate * share[:, None] * grad
    return Model(labels, table @ weights, bias)


def _calibrate(model: Model, samples: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    if not samples:
        return
    z = np.array([share @ model.table[b].astype(np.float64) + model.bias for _, b, share in samples])
    y = np.array([s[0] for s in samples])

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)).mean())

    model.temperature = min((2.0**e for e in np.arange(-3, 3.01, 0.25)), key=loss)
    true = np.sort(model.probabilities(z)[np.arange(len(y)), y])
    model.threshold = float(min(MOST_THRESHOLD, true[math.floor(CALIBRATED_LOSS * len(true))]))


def train(spark: SparkSession, docs: DataFrame, seed: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from docs (doc_id, text, lang), all of which may be learned from; None if there is no label."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    # equal rows share a digest; rows of one doc_id with different texts do not
    digest = F.xxhash64(F.lit(seed), "doc_id", "text")
    # digests are evenly spread, so about four times the sample lies below a cut that follows from a label's rows
    cuts = [(r.lang, min(1.0, 4.0 * sample_rows / r.n)) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not cuts:
        return None
    # one row for each label: tables as small as the set of classes
    below = F.broadcast(spark.createDataFrame(cuts, "lang string, cut double"))
    low = known.select("lang", digest.alias("h")).join(below, "lang").filter((F.col("h") / F.lit(float(1 << 63)) + 1) / 2 <= F.col("cut")).select("lang", "h").distinct()
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    least = ranked.filter(F.col("r") <= sample_rows).groupBy("lang").agg(F.max("h").alias("most")).collect()
    if not least:
        return None
    labels = sorted(r.lang for r in least)
    most = spark.createDataFrame([(r.lang, r.most) for r in least], "lang string, most_ long")
    chosen = known.withColumn("h_", digest).join(F.broadcast(most), "lang").filter(F.col("h_") <= F.col("most_")).select("lang", "h_", "text").dropDuplicates(["lang", "h_"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(2)):
                own: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
                for bucket, place in features(data, offs):
                    at = np.searchsorted(place, offs)
                    for r in range(hi - lo):
                        own[r].append(bucket[at[r] : at[r + 1]])
                found = [np.unique(np.concatenate(x), return_counts=True) for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([(c / max(c.sum(), 1)).astype(np.float32) for _, c in found], pa.list_(pa.float32()))], ["lang", "h", "b", "c"])

    # the driver holds no more than sample_rows texts a label, as the distinct features of each: 8 bytes for each of at most BUCKETS
    number = {x: i for i, x in enumerate(labels)}
    sampled = chosen.mapInArrow(count, "lang string, h long, b array<int>, c array<float>").toArrow()
    told: list[tuple] = []
    for part in sampled.to_batches():
        lang, h, b, c = part.columns
        told += [(h[i].as_py(), number[lang[i].as_py()], b[i].values.to_numpy(), c[i].values.to_numpy()) for i in range(part.num_rows) if len(b[i])]
    samples = [x[1:] for x in sorted(told, key=lambda x: x[:2])]
    if not samples:
        return None
    held = [s for i, s in enumerate(samples) if i % 4 == 3]
    model = fit([s for i, s in enumerate(samples) if i % 4 != 3], labels, seed)
    _calibrate(model, held)
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, carry: list[str]) -> DataFrame:
    """The columns `carry`, lang_pred, score (0 to 1) and rejected, for every row of docs."""
    sent = spark.sparkContext.broadcast(model)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(0)):
                best, score, known = ["und"] * (hi - lo), np.zeros(hi - lo), has_letter(data, offs)
                if m is not None:
                    p = m.probabilities(m.logits(data, offs))
                    top = p.argmax(1)
                    score = np.where(known, p[np.arange(hi - lo), top], 0.0)
                    best = [m.labels[t] if k else "und" for t, k in zip(top, known, strict=True)]
                rejected = np.array([x == "und" for x in best]) | (score < (m.threshold if m else 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + i).slice(lo, hi - lo) for i in range(len(carry))), pa.array(best, pa.string()), pa.array(score), pa.array(rejected)], [*carry, "lang_pred", "score", "rejected"])

    return docs.select("text", *(F.col(f"`{c}`") for c in carry)).mapInArrow(run, schema)


def keep_known(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that the model rejects, columns unchanged."""
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = []
            for _, _, data, offs in slices(batch.column(at)):
                good = has_letter(data, offs)
                if m is None:
                    good[:] = False
                else:
                    good &= m.probabilities(m.logits(data, offs)).max(1) >= m.threshold
                keep.append(good)
            keep = np.concatenate([np.zeros(0, bool), *keep])
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: all but every fourth by digest of doc_id."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; the model never sees held-out ones."""
    model = train(spark, learnable(docs.select("doc_id", "text", "lang")))
    out = predict(spark, docs, model, ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
