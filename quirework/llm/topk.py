"""Exact top-k by inner product with a bit-sliced index.

Vectors are quantised, each component to floor(scale * x). A task indexes its vectors in blocks of BLOCK_ROWS:
of every attribute (component) the SLICES most significant bits, over the block's range, become bitmaps with
one bit per row. For a query, the bitmaps are added with the query's components as weights, by carry-save
adders on whole bitmaps; a negative weight takes the complemented bitmap. The sums are themselves bit slices:
going from the most significant one downward gives the k-th highest sum. What the index leaves out of a score
has a known bound, so only rows within that bound of the k-th sum can be among the top k. These boundary rows
are resolved by the exact integer product.

The queries are a stated set, read in blocks of QUERY_ROWS, each one pass over all vectors. A block of
vectors returns at most k rows per query, merged per query afterwards.

Vectors that are null or hold null or non-finite components take no part; vectors of another length than the
query's are no candidates of it. Rows with the query's own vec_id are the query's own. Null vec_id is never a
query, and as a candidate comes last among ties. Every row of a repeated query id is a query. Components beyond
2^20 after quantising leave the index and are scored exactly with unbounded integers; a score beyond 64 bits is
held at the bound. An empty table gives an empty one. Columns but vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep

BLOCK_ROWS = 1 << 16
QUERY_ROWS = 4096
SLICES = 6
LARGE = 1 << 20
LAST_ID = np.int64(2**63 - 1)


def quantised(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) by length of vector; rows that take no part are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(rows)).flatten()
        x = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), int(d))
        good = np.isfinite(x).all(1)
        x = np.floor(scale * x[good])
        large = (np.abs(x) > LARGE).any(1)
        if (~large).any():
            yield rows[good][~large], x[~large].astype(np.int64)
        if large.any():
            yield rows[good][large], np.array([[int(v) for v in r] for r in x[large].tolist()], object).reshape(int(large.sum()), int(d))


class SlicedIndex:
    """Bitmaps of the leading bits of every attribute of a block of vectors."""

    def __init__(self, x: np.ndarray, slices: int = SLICES):
        self.x, (self.n, self.d) = x, x.shape
        self.low = x.min(0)
        width = [int(r).bit_length() for r in (x.max(0) - self.low)]
        self.shift = [max(0, w - slices) for w in width]
        self.bits = [min(w, slices) for w in width]
        self.valid = self._bitmap(np.ones(self.n, bool))
        self.slices = [[self._bitmap(((x[:, j] - self.low[j]) >> (self.shift[j] + b)) & 1) for b in range(self.bits[j])] for j in range(self.d)]
        self.inverse = [[~s for s in row] for row in self.slices]

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[dict[int, np.ndarray], int]:
        """Bit slices of the weighted sums, and how much more a row's score (less a constant) can be."""
        weight = np.abs(q).tolist()
        left_out = sum(w * ((1 << s) - 1) for w, s in zip(weight, self.shift, strict=True))
        terms = [(w << (self.shift[j] + b), self.slices[j][b] if q[j] >= 0 else self.inverse[j][b]) for j, w in enumerate(weight) if w for b in range(self.bits[j])]
        least = 0  # bits of weights below this add less than a quarter to what is left out anyway
        while sum(w & ((2 << least) - 1) for w, _ in terms) * 4 <= left_out:
            least += 1
        left_out += sum(w & ((1 << least) - 1) for w, _ in terms)
        columns: dict[int, list[np.ndarray]] = {}
        for w, s in terms:
            for j in range(least, w.bit_length()):
                if w >> j & 1:
                    columns.setdefault(j, []).append(s)
        out, j = {}, least
        while columns:
            col = columns.pop(j, [])
            while len(col) > 2:
                a, b, c = col.pop(), col.pop(), col.pop()
                x = a ^ b
                columns.setdefault(j + 1, []).append((a & b) | (x & c))
                col.insert(0, x ^ c)
            if len(col) == 2:
                a, b = col
                columns.setdefault(j + 1, []).append(a & b)
                col = [a ^ b]
            if col:
                out[j] = col[0]
            j += 1
        return out, left_out

    def candidates(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best, own rows left out."""
        sums, left_out = self.sums(q)
        rest = self.valid & ~self._bitmap(own)
        if int(np.bitwise_count(rest).sum()) > k:
            top, need, value = sorted(sums, reverse=True), k, 0
            tied = rest
            for j in top:  # the k-th highest sum, from the most significant slice downward
                one = tied & sums[j]
                n = int(np.bitwise_count(one).sum())
                if n >= need:
                    tied, value = one, value | 1 << j
                else:
                    need -= n
                    tied = tied & ~sums[j]
            value = max(0, value - left_out)
            above, equal = np.zeros_like(rest), rest
            for j in range(max([value.bit_length() - 1, *top]), min([0, *top]) - 1, -1):
                s = sums.get(j)
                if value >> j & 1:
                    equal = equal & s if s is not None else np.zeros_like(rest)
                elif s is not None:
                    above = above | (equal & s)
                    equal = equal & ~s
            rest = above | equal
        return np.flatnonzero(np.unpackbits(rest.view(np.uint8), count=self.n, bitorder="little"))


def _best(ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(row, score) of the k highest scores, ties to smaller ids."""
    if len(rows) > k:
        keep = scores >= np.partition(scores, -k)[-k]
        rows, scores = rows[keep], scores[keep]
    order = np.lexsort((ids[rows], ~scores))
    return [(int(rows[i]), int(scores[i])) for i in order[:k]]


def _held(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of `vectors` for every row of `queries`.

    Both have vec_id and embedding.
    """
    n = queries.count()
    n_blocks = max(1, -(-n // query_rows))
    keyed = queries.select("vec_id", "embedding")
    out = None
    schema = "query_no long, query_id long, vec_id long, score long"
    for b in range(n_blocks):
        part = keyed if n_blocks == 1 else keyed.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)
        table = part.toArrow()
        ids = table.column("vec_id").combine_chunks()
        sets = [(ids.take(pa.array(rows)).to_pylist(), x) for rows, x in quantised(table.column("embedding"), scale)]
        sent = spark.sparkContext.broadcast(sets)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, b=b) -> Iterator[pa.RecordBatch]:
            for vec_ids, column in _blocks(batches):
                null = pc.is_null(vec_ids).to_numpy(zero_copy_only=False)
                key = np.where(null, LAST_ID, pc.fill_null(vec_ids, 0).to_numpy(zero_copy_only=False))
                rows_out = []
                for rows, x in quantised(column, scale):
                    own_ids, own_null = key[rows], null[rows]
                    index = SlicedIndex(x) if x.dtype != object and x.shape[1] else None
                    no = 0
                    for q_ids, q in sent.value:
                        for i, (q_id, v) in enumerate(zip(q_ids, q, strict=True)):
                            if len(v) != x.shape[1]:
                                continue
                            own = (own_ids == q_id) & ~own_null
                            if index is None or q.dtype == object:
                                some = np.flatnonzero(~own)
                                scores = np.array([_held(sum(int(a) * int(c) for a, c in zip(r, v, strict=True))) for r in x[some].tolist()], np.int64)
                            else:
                                some = index.candidates(v, k, own)
                                scores = x[some] @ v
                            rows_out += [(b << 32 | no + i, q_id, None if own_null[r] else int(own_ids[r]), s) for r, s in _best(own_ids, scores, some, k)]
                        no += len(q_ids)
                cols = list(zip(*rows_out, strict=True)) if rows_out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_no", "query_id", "vec_id", "score"])

        found = vectors.select("vec_id", "embedding").mapInArrow(run, schema)
        if n_blocks > 1:  # one block of queries is held at a time
            found = keep(found, "found")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            if n and n + part.num_rows > BLOCK_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                yield t.column(0).combine_chunks(), t.column(1).combine_chunks()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t.column(0).combine_chunks(), t.column(1).combine_chunks()


#: op2_topk in DuckDB's SQL
REPORT_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
