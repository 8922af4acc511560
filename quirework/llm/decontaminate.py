"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task builds suffix arrays over shards (runs of whole documents) of its rows; every suffix of the
benchmark items is binary-searched in them. Only suffixes that open with words some item also has side by
side are kept in an array, the others cannot match. The benchmark is the stated query set: it is read in
blocks of at most BLOCK_BYTES of text, so what is sent to the executors has a fixed bound, and each block is
one pass over the documents.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is `size`
consecutive words of an item; an item with fewer words is one window; one without words has none.
Null text has no words. A null item_id counts as the empty string. Rows of one item_id are one item.
Words are compared by 64-bit fingerprints. A document is searched by one task as a whole, however long; its suffixes that can
match take 40 bytes each. An empty table of documents gives an empty result; without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import discard, keep
from ._text import ALNUM, U, mix, slices, words

#: benchmark text in one pass over the documents
BLOCK_BYTES = 8 << 20
#: text and kept suffixes of one suffix array
SHARD_BYTES, SHARD_SUFFIXES = 16 << 20, 400_000
TABLE_BITS = 20


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> U(64 - TABLE_BITS)).astype(np.int64)


class Windows:
    """The windows of a block of items, ready to be searched."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size = size
        texts = pa.array([t for _, t in items], pa.string())
        parts = [(lo, *words(d, o, ALNUM)[2:]) for lo, _, d, o in slices(texts)]
        hashes = [h[woffs[r] : woffs[r + 1]] for _, h, woffs in parts for r in range(len(woffs) - 1)]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U)
        self.in_vocabulary = np.zeros(1 << TABLE_BITS, bool)
        self.in_vocabulary[_slot(self.vocabulary)] = True
        names = sorted({n for n, _ in items})
        number = {n: i for i, n in enumerate(names)}
        self.names = names
        rows, lengths, owners, starts = [], [], [], []
        for (name, _), h in zip(items, hashes, strict=True):
            ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.uint32)
            m = min(size, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                row = np.zeros(size, np.uint32)
                row[:m] = ids[i : i + m]
                rows.append(row)
                lengths.append(m)
                owners.append(number[name])
                starts.append(i)
        key = np.array(rows, np.uint32).reshape(len(rows), size)
        self.key, back = np.unique(key, axis=0, return_inverse=True) if rows else (key, np.zeros(0, np.int64))
        back = back.ravel()
        self.length = np.count_nonzero(self.key, axis=1)
        order = np.argsort(back, kind="stable")
        self.owner, self.start = np.array(owners, np.int64)[order], np.array(starts, np.int64)[order]
        self.owners_from = np.searchsorted(back[order], np.arange(len(self.key) + 1))
        self.low = self._bytes(self.key)
        self.high = self._bytes(np.where(self.key == 0, np.uint32(0xFFFFFFFF), self.key))
        self.gram = int(min(3, self.length.min())) if len(self.key) else 1
        self.opens = np.zeros(1 << TABLE_BITS, bool)
        self.opens[_slot(self.gram_key(self.key[:, : self.gram].astype(U)))] = True

    def _bytes(self, key: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(key.astype(">u4")).view(f"S{4 * self.size}").ravel()

    @staticmethod
    def gram_key(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(columns), U)
        for j in range(columns.shape[1]):
            out = (out + columns[:, j]) * U(0x9FB21C651E98DF25)
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word fingerprints, from 1; 0 for words that no item has."""
        out = np.zeros(len(h), np.uint32)
        if len(self.vocabulary):
            some = np.flatnonzero(self.in_vocabulary[_slot(h)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == h[some], at + 1, 0)
        return out


class Shard:
    """Suffixes of consecutive whole documents; `search` looks every window up in their suffix array."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.counts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.n_words = self.n_suffixes = self.n_bytes = 0

    def add(self, data: np.ndarray, offs: np.ndarray) -> None:
        w = self.w
        _, _, h, woffs = words(data, offs, ALNUM)
        ids, n = w.ids(h), len(h)
        count = np.diff(woffs)
        if len(w.key) and n:
            limit = np.repeat(woffs[1:], count)
            g = w.gram
            at = np.flatnonzero(ids)
            at = at[at + g <= limit[at]]
            for j in range(1, g):
                at = at[ids[at + j] != 0]
            cols = np.stack([ids[at + j] for j in range(g)], 1).astype(U)
            at = at[w.opens[_slot(w.gram_key(cols))]]
            key = np.zeros((len(at), w.size), np.uint32)
            open_ = np.ones(len(at), bool)
            for j in range(w.size):
                open_ &= at + j < limit[at]
                key[:, j] = np.where(open_, ids[np.minimum(at + j, n - 1)], 0)
            self.keys.append(key)
            self.places.append(at + self.n_words)
            self.n_suffixes += len(at)
        self.counts.append(count)
        self.n_words += n
        self.n_bytes += len(data)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, window) of every occurrence by place, and the word offsets by document."""
        offs = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.counts]))]).astype(np.int64)
        if not self.n_suffixes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), offs
        key, place = self.w._bytes(np.concatenate(self.keys)), np.concatenate(self.places)
        order = np.argsort(key, kind="stable")  # the suffix array
        key = key[order]
        lo, hi = np.searchsorted(key, self.w.low, "left"), np.searchsorted(key, self.w.high, "right")
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        window = np.repeat(found, n)
        at = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        place = place[order[at]]
        by = np.argsort(place, kind="stable")
        return place[by], window[by], offs


def _runs(w: Windows, place: np.ndarray, window: np.ndarray, offs: np.ndarray):
    """Longest verbatim matches: (document, item, place in document, place in item, words)."""
    n = (w.owners_from[window + 1] - w.owners_from[window]).astype(np.int64)
    at = np.repeat(w.owners_from[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    place, length = np.repeat(place, n), np.repeat(w.length[window], n)
    item, start = w.owner[at], w.start[at]
    doc = np.searchsorted(offs, place, "right") - 1
    by = np.lexsort((place, place - start, item, doc))
    doc, item, place, start, length = doc[by], item[by], place[by], start[by], length[by]
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(by)]]) - 1 if len(head) else head
    return doc[head], item[head], place[head] - offs[doc[head]], start[head], place[tail] - place[head] + length[tail]


def _hit_words(place: np.ndarray, length: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words inside any occurrence, by document."""
    step = np.bincount(place, minlength=offs[-1] + 1)[: offs[-1] + 1] - np.bincount(place + length, minlength=offs[-1] + 1)[: offs[-1] + 1]
    total = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)]) if offs[-1] else np.zeros(1, np.int64)
    return np.diff(total[offs])


def _blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[Windows]:
    """The items in blocks of about block_bytes of text; one block if there is nothing."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        yield Windows([(r.i, r.t) for r in part.collect()], size)


def _passes(spark: SparkSession, benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[tuple]:
    """(broadcast of a block's windows, how to hold the pass's result): as it is if there is one block, else written, so that no more than two blocks are held at a time."""
    blocks = _blocks(benchmark, size, block_bytes)
    windows, after = next(blocks), next(blocks, None)
    if after is None:
        yield spark.sparkContext.broadcast(windows), lambda df: df
        return
    while windows is not None:
        sent = spark.sparkContext.broadcast(windows)
        yield sent, lambda df: keep(df, "pass")
        sent.destroy()
        windows, after = after, next(blocks, None)


def _shards(batches, windows: Windows):
    """(ids of the rows, shard) for runs of rows; column 0 has the ids, column 1 the texts."""
    shard, ids = Shard(windows), []
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column(1)):
            shard.add(data, offs)
            ids.append(batch.column(0).slice(lo, hi - lo))
            if shard.n_bytes >= SHARD_BYTES or shard.n_suffixes >= SHARD_SUFFIXES:
                yield ids, shard
                shard, ids = Shard(windows), []
    if ids:
        yield ids, shard


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches of at least a window: doc_id, item_id, doc_start, item_start, n_words (in words)."""
    out, parts = None, _passes(spark, benchmark, size, block_bytes)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, doc_start long, item_start long, n_words long"
    for sent, written in parts:

        def scan(batches, sent=sent):
            w = sent.value
            for ids, shard in _shards(batches, w):
                doc, item, at, start, n = _runs(w, *shard.search())
                if len(doc):
                    ids = pa.concat_arrays(ids)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array([w.names[i] for i in item], pa.string()), *(pa.array(x.astype(np.int64)) for x in (at, start, n))], ["doc_id", "item_id", "doc_start", "item_start", "n_words"])

        part = written(docs.select("doc_id", "text").mapInArrow(scan, schema))
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window occurs, all their columns unchanged."""
    before = None
    for sent, written in _passes(spark, benchmark, size, block_bytes):
        at = docs.columns.index("text")

        def clean(batches, sent=sent, at=at):
            w = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                shard, first = Shard(w), 0
                for _, hi, data, offs in slices(batch.column(at)):
                    shard.add(data, offs)
                    if shard.n_bytes >= SHARD_BYTES or shard.n_suffixes >= SHARD_SUFFIXES or hi == batch.num_rows:
                        place, _, doc_offs = shard.search()
                        keep[first + np.searchsorted(doc_offs, place, "right") - 1] = False
                        shard, first = Shard(w), hi
                yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = written(docs.mapInArrow(clean, docs.schema))
        if before is not None:
            discard(before)
        before = docs
    return docs


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words).

    With more than one block of items, each pass gives its hit ranges and items, which are united by row.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(benchmark, size, block_bytes)
    first, second = next(blocks), next(blocks, None)
    rows = docs.select("doc_id", "text")
    final = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
    several = second is not None
    if several:
        # a row is told apart by its text's digest and doc_id; equal rows have equal results, each copy is counted
        rows = rows.withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256))

    def run(windows):
        sent = spark.sparkContext.broadcast(windows)

        def scan(batches):
            w = sent.value
            for ids, shard in _shards(batches, w):
                place, window, offs = shard.search()
                length = w.length[window] if len(window) else np.zeros(0, np.int64)
                n_hit = _hit_words(place, length, offs)
                doc, item, at, start, n = _runs(w, place, window, offs)
                items: dict[int, set] = {}
                longest = np.zeros(len(offs) - 1, np.int64)
                np.maximum.at(longest, doc, n)
                for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
                    items.setdefault(d, set()).add(w.names[i])
                names = [sorted(items.get(d, ())) for d in range(len(offs) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids), pa.array(np.diff(offs)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0), pa.array(longest)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"],
                )

        return rows.mapInArrow(scan, final)

    if not several:
        return run(first)
    del first, second
    return _report_blocks(spark, rows, _passes(spark, benchmark, size, block_bytes), id_type)


def _report_blocks(spark: SparkSession, rows: DataFrame, passes: Iterator, id_type: str) -> DataFrame:
    """report() for several blocks: hit ranges and items of each block, united by (doc_id, digest of the text)."""
    parts, n_passes = None, 0
    schema = f"doc_id {id_type}, row_key string, n_words long, n long, ranges array<struct<a:long,b:long>>, items array<string>, longest long"
    for sent, written in passes:
        n_passes += 1

        def scan(batches, sent=sent):
            w = sent.value
            for batch in batches:
                for lo, hi, data, offs_b in slices(batch.column(1)):
                    shard = Shard(w)
                    shard.add(data, offs_b)
                    place, window, offs = shard.search()
                    doc, item, at, start, n = _runs(w, place, window, offs)
                    ranges: list[set] = [set() for _ in range(hi - lo)]
                    items: list[set] = [set() for _ in range(hi - lo)]
                    longest = [0] * (hi - lo)
                    for d, i, a, k in zip(doc.tolist(), item.tolist(), at.tolist(), n.tolist(), strict=True):
                        ranges[d].add((a, a + k))
                        items[d].add(w.names[i])
                        longest[d] = max(longest[d], k)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array([1] * (hi - lo), pa.int64()), pa.array([[{"a": a, "b": b} for a, b in sorted(r)] for r in ranges], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest, pa.int64())],
                        ["doc_id", "row_key", "n_words", "n", "ranges", "items", "longest"],
                    )

        part = written(rows.mapInArrow(scan, schema))
        parts = part if parts is None else parts.unionByName(part)
    one = parts.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"), (F.sum("n") / n_passes).cast("int").alias("copies"), F.max("longest").alias("longest_match"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ranges")))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"),
    )
    # sorted ranges: each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        "r",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    return (
        one.withColumn("n_hit", covered)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select("doc_id", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match")
    )
