"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct 5-word shingles, as 64-bit fingerprints. Two documents link when
100 * |intersection| >= 80 * |union|. The result is exact: which documents are connected by links.

1. Equal sets form a class, told by a 64-bit digest of the set; from here on classes are joined.
2. A global order of shingles puts frequent ones last: shingles that occur often inside blocks of rows are
   counted, the counts added up, and the HEAVY_MOST most frequent of them (a fixed bound) are sent to all tasks.
   Any common order gives exact results; this one keeps passages that many documents share out of prefixes.
   Two sets that link share a shingle of their prefixes: the first n - ceil(0.8 n) + 1 shingles of each.
3. Groups of similar documents: every class is compared with up to STARS centres among the classes that share
   STAR_LEAST of its HEAD least shingles. Confirmed links make connected groups, so a large group of near copies takes
   comparisons in proportion to its members, and no link inside a group needs to be looked for again.
4. The token-group matrix has an entry for each (shingle, group) where the shingle is in a member's prefix; other
   classes are groups of one. It is kept by ranges of shingles. An entry also has bounds of its members' sizes and
   of the shingle's place in their prefixes: a pair of sizes a and b that links shares at least 4 (a + b) / 9
   shingles, so its first shared one leaves that many behind it in both sets. Pairs of groups with an
   entry that these bounds allow are candidates. Frequent shingles come late in the order, so documents that have a
   common passage, and much else, do not meet in it.
5. Of two candidate groups the members of the smaller one are queries to the larger. They first meet PROBES of its
   members, as one link is enough. Groups still apart after that: the larger is stored in chunks of about
   CHUNK_SHINGLES with the union of the chunk's sets; a query opens a chunk only if the union holds 80 % of the
   query's set, and then is compared with the chunk's members that it can meet under the bounds of 4.
6. Components of all links, each named by its smallest doc_id.

Before two sets are compared, their parity bitmaps are: 2 to 4 bits for each shingle, each the parity of the
shingles that fall on it. Two bitmaps differ in at most as many bits as the sets do in shingles, so a pair whose
bitmaps differ in more bits than linked sets of these sizes can is out, without its sets. Full sets are
made only for the classes of the pairs left: a Bloom filter of fixed size over those classes filters a scan of the
documents; false positives cost time only.

Null text and text without words have an empty set and link with nothing. A text of fewer than 5 words has
its whole sequence as one shingle. Null doc_id takes part and is never a component's name while others are
there. Rows that repeat a doc_id take part one by one. A text is held by one task as a whole, with some tens of bytes
for each of its own, however long it is. An empty table gives an empty one. Columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import discard, keep
from ._text import SPACED, U, mix, shingles, slices, words

HEAD, STAR_LEAST, STARS, PROBES = 8, 3, 3, 8
BLOCK_SHINGLES = 1 << 21
BLOCK_LEAST, HEAVY_LEAST, HEAVY_MOST = 2, 12, 1 << 20
MATRIX_SHINGLES = 1 << 20
#: sizes in the matrix are kept as powers of this, places in 255ths of the longest prefix
SIZE_STEP = 1.05
CHUNK_SHINGLES = 200_000
BUCKET_ENTRIES = 1 << 18
BLOOM_BITS = 26


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingles) of every row."""
    for lo, hi, data, offs in slices(column):
        _, _, h, woffs = words(data, offs, SPACED)
        s, soffs = shingles(h, woffs, k)
        for r in range(hi - lo):
            yield lo + r, np.unique(s[soffs[r] : soffs[r + 1]])


def _digest(s: np.ndarray) -> int:
    """A set's class."""
    return int(mix(np.array([mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U) + U(len(s))], U))[0].astype(np.int64))


def _parity(s: np.ndarray) -> bytes:
    """A set's parity bitmap: a power of two of bits, at least twice the set's size."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """In how many bits two parity bitmaps differ, the larger one folded to the size of the smaller."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def heavy_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles, rare ones first; copies within a block count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def counted():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= BLOCK_LEAST
            return pa.RecordBatch.from_arrays([pa.array(s[often].view(np.int64)), pa.array(n[often])], ["s", "n"])

        for batch in batches:
            for _, s in _sets(batch.column(0), k):
                if len(s) and (c := _digest(s)) not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
                    if size >= BLOCK_SHINGLES:
                        yield counted()
                        held, size, seen = [], 0, set()
        if held:
            yield counted()

    total = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_LEAST)
    top = total.orderBy(F.desc("n"), "s").limit(HEAVY_MOST).toArrow()
    s, n = top.column("s").to_numpy().view(U), top.column("n").to_numpy()
    return s[np.lexsort((s, n))]


class _Order:
    """The global order of shingles."""

    def __init__(self, heavy: np.ndarray):
        self.rank = np.argsort(heavy, kind="stable")
        self.sorted = heavy[self.rank]

    def ordered(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The set in order, and how many shingles of it are not frequent."""
        if not len(self.sorted):
            return s, len(s)
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        often = self.sorted[at] == s
        return np.concatenate([s[~often], s[often][np.argsort(self.rank[at[often]])]]), int((~often).sum())


def signatures(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, cls, n, own (thousandths of the set that are not frequent), head, prefix, parity of every row; the last four only at a class's first row in a task."""
    sent = spark.sparkContext.broadcast(heavy_shingles(docs, k))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "cls", "n", "own", "head", "prefix", "parity"]
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.int32(), longs, longs, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _Order(sent.value), set()

        def told(s: np.ndarray) -> tuple:
            c = _digest(s) if len(s) else None
            if c is None or c in seen:
                return c, len(s), None, None, None, None
            seen.add(c)
            o, light = order.ordered(s)
            prefix = o[: len(s) - -(-len(s) * percent // 100) + 1].view(np.int64)
            # heads go by digest alone: near copies of a large group share frequent ones
            return c, len(s), 1000 * light // len(s), s[:HEAD].view(np.int64), prefix, _parity(s)

        for batch in batches:
            rows, at, weight = [], 0, 0

            def flushed(batch=batch):
                columns = zip(*rows, strict=True)  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)  # noqa: B023

            for row, s in _sets(batch.column(1), k):
                rows.append(told(s))
                weight += len(rows[-1][4]) if rows[-1][4] is not None else 0
                if weight > 1 << 18:
                    yield flushed()
                    rows, at, weight = [], row + 1, 0
            if rows:
                yield flushed()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, cls long, n long, own int, head array<long>, prefix array<long>, parity binary")


def _full_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cls, n, s (all shingles) of the classes in `wanted` (column cls), one row each."""
    sent = spark.sparkContext.broadcast(_bloom(spark, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            cls, n, sets, weight = [], [], [], 0

            def flushed():
                return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "n", "s"])  # noqa: B023

            for _, s in _sets(batch.column(0), k):
                if not len(s) or (c := _digest(s)) in seen or not _may_hold(bits, c):
                    continue
                seen.add(c)
                cls.append(c)
                n.append(len(s))
                sets.append(s.view(np.int64))
                weight += len(s)
                if weight > 1 << 18:
                    yield flushed()
                    cls, n, sets, weight = [], [], [], 0
            if n:
                yield flushed()

    return docs.select("text").mapInArrow(run, "cls long, n long, s array<long>").dropDuplicates(["cls"])


def _slots(c: int) -> tuple[int, int]:
    x = mix(np.array([c], np.int64).view(U))
    return int(x[0] >> U(64 - BLOOM_BITS)), int(mix(x + U(1))[0] >> U(64 - BLOOM_BITS))


def _may_hold(bits: np.ndarray, c: int) -> bool:
    return all(int(bits[b >> 6]) >> (b & 63) & 1 for b in _slots(c))


def _bloom(spark: SparkSession, wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of 2^BLOOM_BITS bits over the column cls, put together from words of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BLOOM_BITS - 6), U)
        for batch in batches:
            x = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
            for b in (x >> U(64 - BLOOM_BITS), mix(x + U(1)) >> U(64 - BLOOM_BITS)):
                np.bitwise_or.at(bits, (b >> U(6)).astype(np.int64), U(1) << (b & U(63)))
        w = np.flatnonzero(bits)
        for a in range(0, len(w), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(w[a : a + (1 << 16)]), pa.array(bits[w[a : a + (1 << 16)]].view(np.int64))], ["w", "v"])

    word = wanted.select("cls").mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), U)
    out[word.column("w").to_numpy()] = word.column("v").to_numpy().view(U)
    return out


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that can link by their sizes and parity bitmaps; classes: cls, n, parity."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    # sets of the sizes na and nb that link differ in at most this share of na + nb
    share = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            good = [_differing(x[i], y[i]) <= share * n[i] + 1e-6 for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], ["a", "b"])

    fits = (100 * F.least("na", "nb")) >= percent * F.greatest("na", "nb")
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits)
    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "pa", "pb").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that link."""
    one, two = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _compared(spark: SparkSession, docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that link, in a kept table."""
    close = keep(_close(pairs, classes, percent), "close")
    if close.isEmpty():
        return close
    out = keep(_links(close, _full_sets(spark, docs, _both(close), k), percent), "links")
    discard(close)
    return out


def _both(pairs: DataFrame) -> DataFrame:
    """cls: the classes of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: every node of the edges (a, b) with the smallest node that it is connected to.

    Each round takes the least label among a node and its neighbours, then the label of that label.
    """
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        far = labels.select(F.col("node").alias("at"), F.col("comp").alias("far"))
        after = keep(lower.join(far, lower["comp"] == far["at"], "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), (F.col("old") != F.least("comp", F.coalesce("far", "comp"))).alias("moved")), "labels")
        moved = after.filter("moved").limit(1).count()
        discard(labels)
        kept_at, labels = after._kept_at, after.drop("moved")
        labels._kept_at = kept_at
        if not moved:
            discard(both)
            return labels


def _central(n: int):
    """Up to n classes of a group, dealt by digest, each with the least share of rare shingles: near copies with few changes of their own."""
    turn, by = F.pmod(F.xxhash64("cls"), F.lit(n)), F.col("own").cast("long") * (1 << 40) + F.pmod(F.xxhash64(F.lit(1), "cls"), F.lit(1 << 40))
    return F.array_compact(F.array(*(F.min_by("cls", F.when(turn == i, by)) for i in range(n))))


def _stars(sig: DataFrame) -> DataFrame:
    """(a, b): every class with the centres that it shares most of its head with."""
    head = sig.filter("head is not null").select("cls", "own", F.explode("head").alias("t"))
    centre = head.groupBy("t").agg(_central(STARS).alias("b"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("t", "b")
    pairs = head.join(centre, "t").select("cls", "t", F.explode("b").alias("b")).filter(F.col("cls") != F.col("b"))
    shared = pairs.groupBy("cls", "b").agg(F.countDistinct("t").alias("k")).filter(F.col("k") >= STAR_LEAST)
    best = Window.partitionBy("cls").orderBy(F.desc("k"), "b")
    top = shared.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= STARS)
    # a pair may come from both sides
    return top.select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()


def _merged(t, g, *bounds):
    """One entry for each (t, g): least low size, greatest high size, least place."""
    by = np.lexsort((g, t))
    t, g = t[by], g[by]
    head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])]))
    lo, hi, at = (x[by] for x in bounds)
    return t[head], g[head], np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head), np.minimum.reduceat(at, head)


def _meet_here(lo, hi, at, i, j, share: float) -> np.ndarray:
    """Whether sets of the entries i and j can link with this shingle as the first one they share."""
    low, high = SIZE_STEP ** lo.astype(np.float64), SIZE_STEP ** (hi.astype(np.float64) + 1)
    high[hi == 255] = np.inf
    fits = np.minimum(high[i], high[j]) >= share * np.maximum(low[i], low[j]) * (1 - 1e-9)

    def early(x, y):
        return at[x] / 255.0 * (1 - share) <= 1 - share / (1 + share) * (1 + np.maximum(share, low[y] / high[x])) + 1e-9

    return fits & early(i, j) & early(j, i)


def _matrix_pairs(rows: DataFrame, n_entries: int, percent: int) -> DataFrame:
    """(a, b): groups a < b that can link with a shared entry as the first; rows: prefix, comp, n."""
    bits = max(4, (max(1, n_entries) // BUCKET_ENTRIES).bit_length())
    share = percent / 100
    names = ["bucket", "t", "g", "s"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed():
            t, g, lo, hi, at = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            s = np.stack([lo, hi, at], 1)
            bucket = (t >> U(64 - bits)).astype(np.int32)
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(t)]])
            blobs = [(t[a:b].tobytes(), g[a:b].tobytes(), s[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *(pa.array([x[i] for x in blobs], pa.binary()) for i in range(3))], names)

        for batch in batches:
            column, comp, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            offs = column.offsets.to_numpy()
            count = np.diff(offs)
            place = np.arange(offs[-1] - offs[0]) - np.repeat(offs[:-1] - offs[0], count)
            at = np.floor(place / np.repeat(n, count) / (1 - share) * 255 * (1 - 1e-12)).clip(0, 255) if share < 1 else np.zeros(len(place))
            size_ = np.repeat(np.floor(np.log(n) / np.log(SIZE_STEP) + 1e-9).clip(0, 255).astype(np.uint8), count)
            low = np.where(SIZE_STEP ** size_.astype(np.float64) > np.repeat(n, count), size_ - 1, size_).astype(np.uint8)
            held.append((column.flatten().to_numpy().view(U), np.repeat(comp, count), low, size_, at.astype(np.uint8)))
            size += len(place)
            if size >= MATRIX_SHINGLES:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired(blobs):
            t, g, s = (b"".join(x) for x in zip(*blobs, strict=True))
            s = np.frombuffer(s, np.uint8).reshape(-1, 3)
            t, g, lo, hi, at = _merged(np.frombuffer(t, U), np.frombuffer(g, np.int64), s[:, 0], s[:, 1], s[:, 2])
            gap, some = 1, np.arange(len(t) - 1)
            while len(some):
                some = some[some + gap < len(t)]
                some = some[t[some] == t[some + gap]]
                near = some[_meet_here(lo, hi, at, some, some + gap, share)]
                if len(near):
                    pair = np.unique(np.stack([g[near], g[near + gap]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
                gap += 1

        bucket, held = None, []
        for batch in batches:
            for i, x in enumerate(batch.column(0).to_pylist()):
                if x != bucket and held:
                    yield from paired(held)
                    held = []
                bucket = x
                held.append(tuple(batch.column(j)[i].as_py() for j in range(1, 4)))
        if held:
            yield from paired(held)

    dealt = rows.select("prefix", "comp", "n").mapInArrow(deal, "bucket int, t binary, g binary, s binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def join(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sig = keep(signatures(spark, docs, k, percent), "signatures")
    ids = keep(sig.select("doc_id", "n", "cls"), "ids")
    classes = keep(sig.filter("prefix is not null").select("cls", "n", "own", "parity").dropDuplicates(["cls"]), "classes")
    stars = keep(_stars(sig), "stars")
    links = _compared(spark, docs, stars, classes, k, percent)
    discard(stars)
    groups = components(links)
    # groups of one are named by their class
    grouped = lambda df: df.join(groups.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    n_entries = sig.agg(F.sum(F.greatest(F.size("prefix"), F.lit(0)))).first()[0] or 0
    pairs = _matrix_pairs(grouped(sig.filter("prefix is not null").select("cls", "n", "prefix")), n_entries, percent)
    member = grouped(classes.select("cls", "n", "own"))
    size = member.groupBy("comp").agg(F.min("n").alias("l"), F.max("n").alias("h"), F.count("*").alias("m"), F.sum("n").alias("w"))
    side = lambda x: size.select(F.col("comp").alias(x), F.col("l").alias(f"l{x}"), F.col("h").alias(f"h{x}"), F.col("m").alias(f"m{x}"), F.col("w").alias(f"w{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("ha", "hb") >= percent * F.greatest("la", "lb"))
    # the smaller group asks the larger one
    asks = (F.col("ma") < F.col("mb")) | ((F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(asks, F.col(x)).otherwise(F.col(y))
    near = keep(near.select(pick("a", "b").alias("q"), pick("b", "a").alias("g"), pick("mb", "ma").alias("mg"), pick("wb", "wa").alias("wg")), "near")
    single = near.filter("mg = 1").select(F.col("q").alias("a"), F.col("g").alias("b"))
    large = near.filter("mg > 1").select("q", "g", F.greatest(F.lit(1), F.ceil(F.col("wg") / CHUNK_SHINGLES)).cast("long").alias("parts"))
    own = member.select(F.col("comp").alias("q"), F.col("cls").alias("a"), F.col("n").alias("na"))
    probed = member.join(large.select(F.col("g").alias("comp")).distinct(), "comp").groupBy("comp").agg(_central(PROBES).alias("p"))
    meets = large.join(own, "q").join(probed, F.col("g") == F.col("comp")).select("a", F.explode("p").alias("b"))
    probe_links = _compared(spark, docs, single.unionByName(meets).distinct(), classes, k, percent)
    all_links = keep(links.unionByName(probe_links), "links")
    discard(links, probe_links)
    joined = components(all_links)
    same = lambda c, to: joined.select(F.col("node").alias(c), F.col("comp").alias(to))
    apart = large.join(same("q", "cq"), "q", "left").join(same("g", "cg"), "g", "left").filter(F.coalesce("cq", "q") != F.coalesce("cg", "g")).select("q", "g", "parts")
    apart = keep(apart, "apart")
    discard(near)
    if not apart.isEmpty():
        opened = _opened(spark, docs, sig, member, own, apart, k, percent)
        more = _compared(spark, docs, opened, classes, k, percent)
        if not more.isEmpty():
            last = keep(all_links.unionByName(more), "links")
            discard(joined)
            joined = components(last)
            discard(last)
        discard(opened, more)
    discard(apart, all_links, groups, sig, classes)
    final = joined.select(F.col("node").alias("cls"), "comp")
    least = ids.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(final, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "component_id")
    out = ids.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _opened(spark: SparkSession, docs: DataFrame, sig: DataFrame, member: DataFrame, own: DataFrame, apart: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the classes a of the groups q with the members b that they can meet in the chunks of g that they open; apart: q, g, parts."""
    asked = apart.join(own, "q").select("a", "na", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"))
    chunked = member.join(apart.select("g", "parts").distinct(), F.col("comp") == F.col("g")).select("g", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("chunk"), F.col("cls").alias("b"), F.col("n").alias("nb"))
    sets = keep(_full_sets(spark, docs, asked.select(F.col("a").alias("cls")).unionByName(chunked.select(F.col("b").alias("cls"))).distinct(), k), "sets")
    union = chunked.join(sets.select(F.col("cls").alias("b"), "s"), "b").groupBy("g", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("u"))
    open_ = asked.join(sets.select(F.col("cls").alias("a"), "s"), "a").join(union, ["g", "chunk"]).filter(100 * F.size(F.array_intersect("s", "u")) >= percent * F.col("na")).select("a", "na", "g", "chunk")
    open_ = keep(open_, "open")
    discard(sets)
    # an opened chunk's members are reached by their prefixes, under the exact bound on the first shared shingle
    prefixes = sig.filter("prefix is not null").select("cls", "prefix").dropDuplicates(["cls"])
    ask = open_.join(prefixes, F.col("a") == F.col("cls")).select("a", "na", "g", "chunk", F.posexplode("prefix").alias("pa", "t"))
    told = chunked.join(open_.select("g", "chunk").distinct(), ["g", "chunk"]).join(prefixes, F.col("b") == F.col("cls")).select("b", "nb", F.col("g").alias("g_"), F.col("chunk").alias("chunk_"), F.posexplode("prefix").alias("pb", "t_"))
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    meet = (F.col("g") == F.col("g_")) & (F.col("chunk") == F.col("chunk_")) & (F.col("t") == F.col("t_")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("pa") <= F.col("na") - least) & (F.col("pb") <= F.col("nb") - least)
    out = keep(ask.join(told, meet).select("a", "b").distinct(), "opened")
    discard(open_)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document left of each component, its row of the least doc_id; columns unchanged.

    Rows equal in doc_id (or without one) and text count as one document. Rows that share a doc_id but not their
    text are documents of their own. Rows without doc_id go where their component has one with a doc_id.
    """
    names, taken = docs.columns, {c.lower() for c in docs.columns}
    digest = next(x for i in range(len(names) + 1) if (x := f"text_digest_{i}") not in taken)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = keep(join(spark, docs.select(key.alias("doc_id"), "text"), k, percent), "joined")
    gone = keep(found.filter("doc_id != component_id").select(F.col("doc_id.id").alias("id"), F.col("doc_id.text").alias("text")).distinct(), "gone")
    repeated = not found.groupBy("doc_id").count().filter("count > 1").isEmpty()
    discard(found)
    out = docs.withColumn(digest, F.xxhash64("text"))
    out = out.join(gone, out["doc_id"].eqNullSafe(gone["id"]) & (out[digest] == gone["text"]), "left_anti")
    if repeated:
        out = out.dropDuplicates(["doc_id", digest])
    return out.select(*(F.col(f"`{c}`") for c in names))
