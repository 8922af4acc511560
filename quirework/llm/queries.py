"""The queries opN_<name>: each applies one operator with production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sharding, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 1: words, hit words and items of every document."""
    from .decontaminate import report

    return report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 3: the component of every document."""
    from .jaccard import join

    return join(spark, _table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 4: words taken from every document for the target mixture."""
    from .mixing import allot

    return allot(_table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that repeat across documents."""
    from .passages import repeats

    return repeats(spark, _table(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 7, law `rows`: shard and slot of every document."""
    from .sharding import report

    return report(_table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 2: the ten best rows for every vector whose id is divisible by 100."""
    from .topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(spark, vectors, vectors.filter("pmod(vec_id, 100) = 0"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 5: pages written as WARC archives and read back."""
    from .warc import report

    return report(spark, _table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 8: secrets in every document."""
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 9: the language of every document."""
    from .langid import report

    return report(spark, _table(spark, sf_dir, "documents"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 10: scores of every document."""
    from .ctw import report

    return report(spark, _table(spark, sf_dir, "documents"))


#: op3_jaccard in DuckDB's SQL, for tables of some thousand documents
JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT i, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
u AS (SELECT i, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.i AS a, b.i AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.i <> b.i GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT i, i AS j FROM s UNION SELECT r.i, l.b FROM r JOIN l ON r.j = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN r ON s.i = r.i JOIN s t ON t.i = r.j GROUP BY s.i, s.doc_id, s.g
"""

#: op1_decontaminate in DuckDB's SQL
DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
x AS (
  SELECT item, row, m, unnest(range(len(w) - m + 1)) AS s, unnest(list_transform(range(len(w) - m + 1), lambda k: array_to_string(w[k + 1 : k + m], ' '))) AS g
  FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0)),
u AS (SELECT r, unnest(range(len(w))) AS k, unnest(w) AS word FROM d),
v AS (SELECT r, k, list(word) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM u),
p AS (SELECT r, m, k, array_to_string(ten[1 : m], ' ') AS g FROM v, (SELECT DISTINCT m FROM x) WHERE len(ten) >= m),
h AS (SELECT r, p.m, p.k, x.item, x.row, x.s FROM p JOIN x ON p.m = x.m AND p.g = x.g),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS place FROM (SELECT DISTINCT r, k, m FROM h)) GROUP BY 1),
l AS (SELECT r, count(*) + any_value(m) - 1 AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY r, row, s - k ORDER BY k) AS island FROM h) GROUP BY r, row, s - k, island),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce((SELECT max(n) FROM l WHERE l.r = d.r), 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r
"""

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_topk, op3_jaccard, op4_mix, op5_warc, op6_passages, op7_shard, op8_secrets, op9_langid, op10_ctw)}
ORACLES: dict[str, str] = {"op1_decontaminate": DECONTAMINATE_SQL, "op2_topk": topk.REPORT_SQL, "op3_jaccard": JACCARD_SQL, "op5_warc": warc.REPORT_SQL, "op7_shard": sharding.REPORT_SQL}
