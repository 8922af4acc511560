"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes, A-Z lower-cased, and an end symbol (0; a NUL in a text counts as 0xFF). A byte is
decomposed into eight binary decisions, each with its own context tree over the preceding bytes, DEPTH bytes
deep (0 before the text begins). Every node has a Krichevsky-Trofimov estimator; a node's weighted
probability is half its own estimate and half the product of its children's, which mixes all depths. A KT
block probability depends on the counts alone, so the trees of a whole corpus follow from its counts of
(context, byte): each task counts, a shuffle adds the counts up, and the trees are weighted bottom-up. Nodes of
depth 2 and more are computed by tasks that hold whole two-byte contexts; the 256 * 255 nodes of depth 1 and
the 255 of depth 0 need only sums over those, which have a fixed bound. The weighted model, fixed after
training, predicts each bit by the posterior mixture along its context path; the sum of the logarithms is the
code length.

The base score is a unigram model over words with add-half smoothing.

Both scores look up a table of logarithms. If both tables have at most MOST_ENTRIES entries, they are sent to the tasks
as hash tables. Beyond that nothing is sent: blocks of texts ask for the logarithms of their distinct words and grams by a
join, and each is scored by a task that holds it and its answers.

Null text is empty: it has the end token, and the end symbol. Rows with null doc_id are not learned from and not
held out. If there is nothing to learn from, all counts are 0. Words and contexts are told apart by 64-bit
fingerprints and by their bytes, in turn. Rows of one doc_id are scored one by one. A text is scored by one task as a whole, with some
tens of bytes for each of its own. An empty table gives an empty one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import discard, keep
from ._text import SPACED, U, mix, slices, whole_groups, words

DEPTH = 5
MOST_ENTRIES = 6_000_000
BLOCK_BYTES, ROUND_BYTES = 4 << 20, 64 << 30
#: positions counted before they are merged
COUNT_ROWS = 1 << 21
END_WORD = U(0x0E0D0E0D0E0D0E0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[0] = 255

# --- counting


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with an end symbol after each row, and the offsets."""
    out_offs = offs + np.arange(len(offs))
    out = np.zeros(out_offs[-1], np.uint8)
    at = np.ones(len(out), bool)
    at[out_offs[1:] - 1] = False
    out[at] = LOWER[data]
    return out, out_offs


def grams(sym: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol its context and itself: the nearest context byte is the most significant, the symbol the least."""
    key, n = sym.astype(U), len(sym)
    starts = offs[:-1]
    for k in range(1, depth + 1):
        near = np.zeros(n, np.uint8)
        near[k:] = sym[: n - k] if k < n else sym[:0]
        for j in range(k):
            at = starts + j
            near[at[at < offs[1:]]] = 0
        key |= near.astype(U) << U(8 * (depth - k + 1))
    return key


class _Counter:
    """Counts of keys, merged now and then so that memory follows the distinct keys."""

    def __init__(self):
        self.keys, self.n, self.open, self.size = np.zeros(0, U), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.open.append(keys)
        self.size += len(keys)
        if self.size > COUNT_ROWS:
            self.merge()

    def merge(self) -> None:
        if self.open:
            k, n = np.unique(np.concatenate(self.open), return_counts=True)
            self.open, self.size = [], 0
            k = np.concatenate([self.keys, k])
            if not len(k):
                return
            order = np.argsort(k, kind="stable")
            k, n = k[order], np.concatenate([self.n, n])[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            self.keys, self.n = k[first], np.add.reduceat(n, first)


WORD, GRAM = 0, 1


def counts(docs: DataFrame, trained: str, depth: int = DEPTH) -> DataFrame:
    """kind (WORD or GRAM), key, n: occurrences in the rows where the column `trained` holds; contexts of other rows have n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, gram, other = _Counter(), _Counter(), _Counter()
        for batch in batches:
            use = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offs in slices(batch.column(0)):
                mine = use[lo:hi]
                _, _, h, woffs = words(data, offs, SPACED)
                word.add(h[np.repeat(mine, np.diff(woffs))])
                word.add(np.full(int(mine.sum()), END_WORD))
                sym, soffs = symbols(data, offs)
                g, by = grams(sym, soffs, depth), np.repeat(mine, np.diff(soffs))
                gram.add(g[by])
                other.add(g[~by])
        for c in (word, gram, other):
            c.merge()
        other.n[:] = 0
        for kind, c in ((WORD, word), (GRAM, gram), (GRAM, other)):
            for a in range(0, len(c.keys), 1 << 16):
                k, n = c.keys[a : a + (1 << 16)], c.n[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    told = docs.select("text", F.coalesce(F.col(trained), F.lit(False)).alias("use")).mapInArrow(run, "kind byte, key long, n long")
    return told.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the trees


def log_kt(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT block probability of n bits with that many ones."""
    return _lgamma_half(ones) + _lgamma_half(n - ones) - _lgamma_whole(n) - np.log(np.pi)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma(x), x > 0, by the recurrence up to 8 and the asymptotic series from there."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift += np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x - shift


_HALF, _WHOLE = _stirling(np.arange(4096) + 0.5), _stirling(np.arange(4096) + 1.0)


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    return np.where(n < 4096, _HALF[np.minimum(n, 4095)], _stirling(np.maximum(n, 1) + 0.5)) if (n >= 4096).any() else _HALF[n]


def _lgamma_whole(n: np.ndarray) -> np.ndarray:
    return np.where(n < 4096, _WHOLE[np.minimum(n, 4095)], _stirling(np.maximum(n, 1) + 1.0)) if (n >= 4096).any() else _WHOLE[n]


def _levels(key: np.ndarray, n: np.ndarray, depth: int, top: int):
    """Tables of distinct (context, byte) by depth from `depth` to `top`, and each row's row in the next shallower one."""
    tables, up = {depth: (key, n)}, {}
    for d in range(depth - 1, top - 1, -1):
        k, c = tables[d + 1]
        short = (k >> U(16)) << U(8) | (k & U(255))
        order = np.argsort(short, kind="stable")
        s = short[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.flatnonzero(first)
        up[d + 1] = np.empty(len(k), np.int64)
        up[d + 1][order] = np.cumsum(first) - 1
        tables[d] = (s[at], np.add.reduceat(c[order], at))
    return tables, up


def weigh(key: np.ndarray, n: np.ndarray, depth: int, top: int):
    """Bit predictions at depth `top` of each gram (8 columns), and the nodes at depth `top`.

    key: ascending distinct grams that hold all grams of their contexts of depth `top`. Nodes: for each of the
    eight levels (context << 8 | bits so far, logarithm of the weighted probability, count, ones).
    """
    tables, up = _levels(key, n, depth, top)
    at = {depth: np.arange(len(key))}
    for d in range(depth - 1, top - 1, -1):
        at[d] = up[d + 1][at[d + 1]]
    out, nodes = np.empty((len(key), 8), np.float32), []
    for level in range(8):
        node, head, total, ones = {}, {}, {}, {}
        for d, (k, c) in tables.items():
            prefix = k >> U(8 - level)
            first = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            head[d], node[d] = np.flatnonzero(first), np.cumsum(first) - 1
            total[d] = np.add.reduceat(c, head[d])
            ones[d] = np.add.reduceat(c * ((k >> U(7 - level)) & U(1)).astype(np.int64), head[d])
        bit = ((key >> U(7 - level)) & U(1)).astype(bool)
        own = lambda d: node[d][at[d]]  # noqa: B023, E731
        kt = lambda d, i: (np.where(bit, ones[d][i], total[d][i] - ones[d][i]) + 0.5) / (total[d][i] + 1.0)  # noqa: B023, E731
        weighted, share = log_kt(total[depth], ones[depth]), {}
        for d in range(depth - 1, top - 1, -1):
            parent = node[d][up[d + 1][head[d + 1]]]
            below = np.bincount(parent, weights=weighted, minlength=len(head[d]))
            mine = log_kt(total[d], ones[d])
            weighted = np.logaddexp(mine, below) - np.log(2)
            share[d] = np.exp(mine - np.log(2) - weighted)
        p = kt(depth, own(depth))
        for d in range(depth - 1, top - 1, -1):
            i = own(d)
            p = share[d][i] * kt(d, i) + (1 - share[d][i]) * p
        out[:, level] = p
        k = tables[top][0][head[top]]
        nodes.append(((k >> U(8)) << U(8) | ((k & U(255)) >> U(8 - level)), weighted, total[top], ones[top]))
    return out, nodes


def finish(nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """From sums by depth-1 node, for each level (c1 << 8 | bits so far, sum over children of the logarithms, count, ones),
    arrays a, b [c1, byte, level]: a bit's probability is a + b * its prediction at depth 2."""
    a, b = np.zeros((256, 256, 8)), np.zeros((256, 256, 8))
    byte = np.arange(256)
    for level in range(8):
        below, total, ones = np.zeros((256, 256)), np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)
        k, s, n, o = nodes.get(level, (np.zeros(0, np.int64),) * 4)
        below[k >> 8, k & 255], total[k >> 8, k & 255], ones[k >> 8, k & 255] = s, n, o
        mine = log_kt(total, ones)
        weighted = np.logaddexp(mine, below) - np.log(2)
        share1 = np.exp(mine - np.log(2) - weighted)
        total0, ones0, below0 = total.sum(0), ones.sum(0), weighted.sum(0)
        mine0 = log_kt(total0, ones0)
        share0 = np.exp(mine0 - np.logaddexp(mine0, below0))
        prefix, bit = byte >> (8 - level), (byte >> (7 - level)) & 1
        pick = lambda t, o: np.where(bit == 1, o[..., prefix] + 0.5, t[..., prefix] - o[..., prefix] + 0.5) / (t[..., prefix] + 1.0)  # noqa: B023, E731
        s0, s1 = share0[prefix], share1[:, prefix]
        a[:, :, level] = s0 * pick(total0, ones0) + (1 - s0) * s1 * pick(total, ones)
        b[:, :, level] = (1 - s0) * (1 - s1)
    return a, b


def gram_logs(spark: SparkSession, gram_counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, log: log10 of the weighted model's probability of each gram's symbol in its context, in a kept table."""
    near = F.shiftrightunsigned("key", 8 * (depth - 1)).alias("near")
    dealt = gram_counts.select("key", "n", near).repartition("near").sortWithinPartitions("near", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        names = ["key", "bits", "level", "below", "n", "ones"]
        for t in whole_groups(batches, ["near"]):
            key, n = t.column("key").to_numpy().view(U), t.column("n").to_numpy()
            p, nodes = weigh(key, n, depth, 2)
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(key), [None, pa.py_buffer(np.ascontiguousarray(p))]).cast(pa.binary())
            none = pa.nulls(len(key), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), bits, pa.array(np.full(len(key), -1, np.int32)), none, pa.array(n), pa.array(n)], names)
            for level, (k, w, c, o) in enumerate(nodes):
                short, back = np.unique((k >> U(16)) << U(8) | (k & U(255)), return_inverse=True)
                s = [np.bincount(back, weights=x, minlength=len(short)) for x in (w, c, o)]
                for x, *v in zip(short.tolist(), *s, strict=True):
                    at = sums.setdefault((level, x), np.zeros(3))
                    at += v
        if sums:
            level, node = (np.array(x) for x in zip(*sums, strict=True))
            v = np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.nulls(len(v), pa.binary()), pa.array(level.astype(np.int32)), pa.array(v[:, 0]), pa.array(v[:, 1].astype(np.int64)), pa.array(v[:, 2].astype(np.int64))], names)

    deep = keep(dealt.mapInArrow(run, "key long, bits binary, level int, below double, n long, ones long"), "ctw")
    # at most 256 * 255 rows, whatever the corpus
    top = deep.filter("level >= 0").groupBy("level", "key").agg(F.sum("below").alias("below"), F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()
    level = top.column("level").to_numpy()
    nodes = {x: tuple(top.column(c).to_numpy()[level == x] for c in ("key", "below", "n", "ones")) for x in range(8)}
    sent = spark.sparkContext.broadcast(tuple(x.astype(np.float32) for x in finish(nodes)))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sent.value
        for batch in batches:
            key = batch.column(0).to_numpy().view(U)
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 8)
            c1, byte = (key >> U(8 * depth)).astype(np.int64), (key & U(255)).astype(np.int64)
            log = np.log10(np.maximum(a[c1, byte] + b[c1, byte] * p, 1e-30).astype(np.float64)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log.astype(np.float32))], ["key", "log"])

    out = keep(deep.filter("level < 0").select("key", "bits").mapInArrow(last, "key long, log float"), "logs")
    discard(deep)
    return out


# --- scoring


class Lookup:
    """A hash table of 64-bit keys with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 1.6).bit_length())
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        at = np.maximum.accumulate(slot[order] - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else slot
        size = max(1 << self.bits, int(at[-1]) + 1 if len(keys) else 0) + 1
        self.keys, self.values = np.zeros(size, U), np.full(size, np.nan, values.dtype)
        self.keys[at], self.values[at] = keys[order], values[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; NaN for keys that the table lacks."""
        at = self._slot(keys)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(out))
        at = at[open_]
        while len(open_):
            at += 1
            value = self.values[at]
            out[open_] = value
            more = (self.keys[at] != keys[open_]) & ~np.isnan(value)
            open_, at = open_[more], at[more]
        return out


def _table(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = table.toArrow()
    return t.column("key").to_numpy().view(U), t.column("log").to_numpy()


def _row_sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return np.diff(total[offs])


SUMS = "n_tokens long, n_known long, base double, log double, n_symbols long"


def _summed(column: pa.Array, by_word: Lookup, by_gram: Lookup, depth: int) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, rows, arrays of SUMS) of slices of the texts; what a table lacks adds nothing."""
    end = by_word.get(np.array([END_WORD]))[0]
    for lo, hi, data, offs in slices(column):
        _, _, h, woffs = words(data, offs, SPACED)
        v = by_word.get(h)
        n_known = _row_sums(~np.isnan(v), woffs).astype(np.int64) + int(not np.isnan(end))
        base = _row_sums(np.nan_to_num(v), woffs) + np.nan_to_num(end)
        sym, soffs = symbols(data, offs)
        log = _row_sums(np.nan_to_num(by_gram.get(grams(sym, soffs, depth))), soffs)
        yield lo, hi - lo, [pa.array(x) for x in (np.diff(woffs) + 1, n_known, base, log, np.diff(offs) + 1)]


def _schema(docs: DataFrame, cols: list[str]) -> tuple[str, list[str]]:
    """The schema of cols and SUMS, and its names."""
    own = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols]
    return ", ".join([*own, SUMS]), [*cols, *(x.split(" ")[0] for x in SUMS.split(", "))]


def _by_broadcast(spark: SparkSession, docs: DataFrame, carry: list[str], word_logs: DataFrame, logs: DataFrame, depth: int) -> DataFrame:
    """carry and SUMS of every row, both tables being sent to all tasks."""
    sent = spark.sparkContext.broadcast((Lookup(*_table(word_logs)), Lookup(*_table(logs))))
    schema, names = _schema(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_gram = sent.value
        for batch in batches:
            for lo, n, sums in _summed(batch.column(0), by_word, by_gram, depth):
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + i).slice(lo, n) for i in range(len(carry))), *sums], names)

    return docs.select("text", *(F.col(f"`{c}`") for c in carry)).mapInArrow(run, schema)


def _in_blocks(docs: DataFrame, carry: list[str], block_bytes: int) -> DataFrame:
    """block, text and carry of every row: runs of rows of a task with about block_bytes of text, in a table that fixes them."""
    cols = ["text", *carry]
    schema = ", ".join(["block long", *(f"`c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = None, 0
        for batch in batches:
            first, lengths = batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            of = []
            for i, n in zip(first, lengths, strict=True):
                if block is None or size + n > block_bytes:
                    block, size = i, 0
                size += n
                of.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *batch.columns[1:]], ["block", *(f"c{i}" for i in range(len(cols)))])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))
    return keep(numbered.mapInArrow(run, schema), "blocks")


def _by_blocks(docs: DataFrame, carry: list[str], word_logs: DataFrame, logs: DataFrame, depth: int, block_bytes: int, round_bytes: int) -> DataFrame:
    """carry and SUMS of every row by joins: a block of texts asks for the logarithms of its distinct words and grams, and is scored with them.

    A task holds one block and what it asked for. Rounds bound the disk: each takes blocks of about round_bytes of text, and its tables are
    deleted before the next.
    """
    blocks = _in_blocks(docs, carry, block_bytes)
    size = blocks.agg(F.sum(F.octet_length("c0"))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    told = word_logs.select(F.lit(WORD).cast("byte").alias("kind"), "key", F.col("log").cast("double")).unionByName(logs.select(F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("log").cast("double")))
    own = [f"c{i + 1}" for i in range(len(carry))]
    schema, names = _schema(blocks, own)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(block, kind, keys):
            k = np.unique(np.concatenate(keys))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64))], ["block", "kind", "key"])

        for t in whole_groups(batches, ["block"]):
            of = t.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                by_word, by_gram = [np.array([END_WORD], U)], []
                for _, _, data, offs in slices(t.column(1).slice(a, b - a)):
                    by_word.append(np.unique(words(data, offs, SPACED)[2]))
                    sym, soffs = symbols(data, offs)
                    by_gram.append(np.unique(grams(sym, soffs, depth)))
                yield asked(of[a], WORD, by_word)
                yield asked(of[a], GRAM, by_gram)

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key, log = answers.column("kind").to_numpy(), answers.column("key").to_numpy().view(U), answers.column("log").to_numpy()
        tables = [Lookup(key[kind == k], log[kind == k]) for k in (WORD, GRAM)]
        text = texts.column("c0").combine_chunks()
        parts = [pa.Table.from_arrays([*(texts.column(c).slice(lo, n) for c in own), *sums], names) for lo, n, sums in _summed(text, *tables, depth)]
        return pa.concat_tables(parts)

    out = None
    for r in range(rounds):
        some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r)
        asked = some.select("block", "c0").mapInArrow(ask, "block long, kind byte, key long")
        answers = asked.join(told, ["kind", "key"]).select("block", "kind", "key", "log")
        sums = keep(some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema), "sums")
        out = sums if out is None else out.unionByName(sums)
    discard(blocks)
    return out.withColumnsRenamed(dict(zip(own, carry, strict=True)))


def score(spark: SparkSession, docs: DataFrame, trained: str, carry: list[str], depth: int = DEPTH, most: int = MOST_ENTRIES, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """carry, n_tokens, n_known, train_tokens, base_score, score, n_symbols of every row; learns from rows where `trained` holds."""
    told = keep(counts(docs, trained, depth), "counts")
    word = told.filter(f"kind = {WORD}")
    size = word.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    unit = size.n + 0.5 * (size.v + 1)
    word_logs = word.select("key", F.log10((F.col("n") + 0.5) / F.lit(unit)).alias("log"))
    unknown = float(np.log10(0.5 / unit))
    logs = gram_logs(spark, told.filter(f"kind = {GRAM}").select("key", "n"), depth)
    if size.v <= most and logs.count() <= most:
        out = _by_broadcast(spark, docs, carry, word_logs, logs, depth)
    else:
        out = _by_blocks(docs, carry, word_logs, logs, depth, block_bytes, round_bytes)
    discard(told, logs)  # both ways have read them
    base = F.col("base") + (F.col("n_tokens") - F.col("n_known")) * F.lit(unknown)
    return out.select(*(F.col(f"`{c}`") for c in carry), "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("log").alias("score"), (-F.col("log") / F.lit(float(np.log10(2))) / F.col("n_symbols")).alias("bits_per_byte"))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    turn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select("doc_id", "text", (turn != 1).alias("trained_"), F.coalesce(turn == 1, F.lit(False)).alias("held_out"))
    return score(spark, rows, "trained_", ["doc_id", "held_out"])
