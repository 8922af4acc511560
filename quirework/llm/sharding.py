"""Sharding by proportional stratified interleaving.

Within each source the rows are ranked in a seeded shuffle; a row of rank r among n has the fractional rank
(2r - 1) / 2n. In the order of fractional ranks every stretch holds the sources in the mixture's
proportions, so cutting it into equal runs of rows gives shards that all match the mixture, with counts at
most one apart.

No rank needs the rows of a source, or all rows, in one task: the shuffle key is a 60-bit digest, evenly
spread, whose leading bits deal each source into buckets; counts by bucket, summed up, give the rank before a
bucket, and a window gives the rank inside it. That window is the only shuffle of whole rows: a row's place among all follows
from its rank and the totals of the sources, in whole numbers. The totals are one row a source; beyond MOST_SOURCES sources, whose
terms would grow with them, the fractional ranks are dealt into buckets and ranked in the same way as the keys.
The number of buckets follows the number of rows.

Null source is a source of its own; null and empty text have no bytes; a long text travels whole, like any other. Null doc_id takes its
place by the text alone. Rows that are equal in doc_id and text are interchangeable. An empty table gives an empty one.
Columns of docs with the names of the result's are replaced; no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096
MOST_SOURCES = 256
LONG = 1 << 62


def _bits(n: int, rows: int) -> int:
    return max(0, min(40, (max(1, n // rows) - 1).bit_length()))


def _by_totals(ranked: DataFrame, totals: list[tuple[str, int]]) -> DataFrame:
    """Adds place: of every source the ranks with a smaller fraction, or the same one and an earlier source.

    Rank r' of n' comes before rank r of n if (2r' - 1) * n <= (2r - 1) * n' (<, for a later source), which holds for the
    first ((2r - 1) * n' + n) div 2n ranks.
    """
    most = max(n for _, n in totals)
    whole = (lambda c: c) if 2 * most * most < LONG else (lambda c: c.cast("decimal(19,0)"))
    others = F.array(*(F.struct(F.lit(name).alias("s"), F.lit(n).cast("long").alias("n")) for name, n in totals))
    odd = F.col("odd_")

    def before(x):
        share = whole(odd) * whole(x["n"]) + whole(F.col("of_")) - F.when(x["s"] > F.col("stratum_"), 1).otherwise(0)
        return F.when(x["s"] == F.col("stratum_"), F.lit(0).cast("long")).otherwise(F.call_function("div", share, whole(2 * F.col("of_"))))

    return ranked.withColumn("place_", F.aggregate(others, F.col("before_") + F.col("at_") - 1, lambda total, x: total + before(x)))


def _by_windows(ranked: DataFrame, totals: DataFrame, n_parts: int) -> DataFrame:
    """Adds place: rows are dealt by fractional rank into n_parts and ranked there."""
    # the part of a row: its fractional rank times the number of parts, in whole numbers
    ranked = ranked.withColumn("part_", F.expr(f"cast(odd_ as decimal(19,0)) * {n_parts} div (2 * of_)"))
    # the rows of a source below part b follow from its total alone: odd * parts < 2 * total * b
    parts = totals.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("part_"), "of_")
    parts = parts.groupBy("part_").agg(F.sum(F.expr(f"(2 * of_ * part_ + {n_parts - 1}L) div {2 * n_parts}L")).alias("below_"))
    inner = Window.partitionBy("part_").orderBy(F.col("odd_") / F.col("of_"), "stratum_", "key_", "doc_id")
    return ranked.withColumn("in_", F.row_number().over(inner)).join(parts, "part_").withColumn("place_", F.col("below_") + F.col("in_") - 1)


def interleave(docs: DataFrame, n_shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS, most_sources: int = MOST_SOURCES, names: tuple = ("shard_", "slot_", "place_")) -> DataFrame:
    """docs (with doc_id, source and text) with its columns, and shard, slot and place in the interleaved order under the given names (None: left out)."""
    taken = {x.lower() for x in names if x}
    n_rows = max(1, docs.count())
    bits, n_parts = _bits(n_rows, bucket_rows), max(1, n_rows // bucket_rows)
    seeded = F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken)).alias("row_"),
        "doc_id",
        F.conv(F.substring(F.md5(seeded), 1, 15), 16, 10).cast("long").alias("key_"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z")).alias("stratum_"),  # null comes last
    ).withColumn("bucket_", F.shiftright("key_", 60 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("stratum_", "bucket_").agg(F.count("*").alias("n_"))
    totals = counts.groupBy("stratum_").agg(F.sum("n_").alias("of_"))
    by_source = Window.partitionBy("stratum_")
    counts = counts.select(
        "stratum_", "bucket_", F.coalesce(F.sum("n_").over(by_source.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("n_").over(by_source).alias("of_")
    )
    within = Window.partitionBy("stratum_", "bucket_").orderBy("key_", "doc_id")
    ranked = rows.withColumn("at_", F.row_number().over(within)).join(counts, ["stratum_", "bucket_"]).withColumn("odd_", 2 * (F.col("before_") + F.col("at_")) - 1)
    few = [(r.stratum_, r.of_) for r in totals.limit(most_sources + 1).collect()]
    placed = _by_windows(ranked, totals, n_parts) if not few or len(few) > most_sources else _by_totals(ranked, few)
    # shard s has the places from ceil(s * rows / shards) on
    shard = F.expr(f"cast(place_ * {n_shards} div {n_rows}L as int)")
    placed = placed.withColumn("shard_", shard).withColumn("slot_", F.expr(f"place_ - (shard_ * {n_rows}L + {n_shards - 1}) div {n_shards}"))
    return placed.select("row_.*", *(F.col(c).alias(to) for c, to in zip(("shard_", "slot_", "place_"), names, strict=True) if to))


def report(docs: DataFrame, n_shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; only these travel, not the texts."""
    slim = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = interleave(slim, n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard_").cast("int").alias("shard"), F.col("slot_").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")


#: op7_shard in DuckDB's SQL
REPORT_SQL = """
WITH RECURSIVE b AS (
  SELECT x, 0 AS step, CAST(x AS BIGINT) AS c FROM range(16) t(x)
  UNION ALL SELECT x, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM b WHERE step < 4),
crc AS (SELECT list(c ORDER BY x) AS tab FROM b WHERE step = 4),
d AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
    list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: CAST(instr('123456789ABCDEF', nullif(x, '')) AS BIGINT)) AS digits
  FROM documents),
k AS (SELECT *, substr(md5(concat_ws(chr(31), '0', coalesce(CAST(doc_id AS VARCHAR), ''), digest)), 1, 15) AS key, coalesce('s' || source, 'z') AS stratum FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id) AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * pos - 1) / n::DOUBLE, stratum, key, doc_id) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, CAST(place * 8 // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size,
       xor(4294967295, list_reduce(digits, lambda c, x: xor(c >> 4, tab[(xor(c, x) & 15) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32,
       'rows' AS law, shard, CAST(place - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM s, crc
"""
