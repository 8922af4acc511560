"""Pages of documents: splitting, counting, contents-page runs and chunk packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, wrap_page


def pages_of(docs: DataFrame, tokens: Callable[[Column | str], Column] = count_words, separator: str = "\n") -> DataFrame:
    """doc_id, page_index (from 1), text, tokens: the pages of texts that hold a separator between pages. No shuffle."""
    paged = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("p", "text"))
    return paged.select("doc_id", (F.col("p") + 1).alias("page_index"), "text", tokens("text").alias("tokens"))


def totals(pages: DataFrame) -> DataFrame:
    """Pages and tokens by document."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("tokens").cast("long").alias("n_tokens"))


def likely_scanned(pages: DataFrame, threshold: int = 30) -> DataFrame:
    """doc_id, median_words (upper median over pages), scanned (below the threshold)."""
    counts = F.sort_array(F.collect_list(count_words("text")))
    out = pages.groupBy("doc_id").agg(counts.alias("w")).select("doc_id", F.element_at("w", F.floor(F.size("w") / 2).cast("int") + 1).alias("median_words"))
    return out.withColumn("scanned", F.coalesce(F.col("median_words") < threshold, F.lit(True)))


def contents_cap(n_pages: Column | str, check_pages: int = 25) -> Column:
    """How many pages are looked at for a table of contents: a third of the document, at least 3, at most check_pages."""
    n = F.col(n_pages) if isinstance(n_pages, str) else n_pages
    return F.least(F.lit(check_pages), F.greatest(F.lit(3), F.floor(n / 3))).cast("int")


def contents_run(pages: DataFrame, answer: str, limit: Column, start: int = 0) -> DataFrame:
    """The pages (doc_id, position from 0) of the first run of `yes` answers at or after position `start`.

    Answers other than yes and no neither add a page nor end the run. Positions from `limit` on are looked at only
    while a run is open.
    """
    at = F.col("page_index") - 1
    looked = pages.select("doc_id", at.alias("position"), F.col(answer).alias("answer"), limit.alias("limit_")).filter(F.col("position") >= start)
    # the first yes below the limit opens the run, the first no after it ends it: two aggregates, no ordering
    yes = looked.filter("answer = 'yes'")
    opened = yes.filter("position < limit_").groupBy("doc_id").agg(F.min("position").alias("first_"))
    joined = looked.filter("answer in ('yes', 'no')").join(opened, "doc_id").filter("position >= first_")
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = joined.withColumn("noes_", F.sum(F.when(F.col("answer") == "no", 1).otherwise(0)).over(before))
    return ended.filter("noes_ = 0").select("doc_id", "position")


def contents_runs(pages: DataFrame, answer: str, limit: Column) -> DataFrame:
    """All runs of contents pages: doc_id, run (from 1), position; every later run begins after the page that ended the one before.

    A run after the first also has to open below the limit.
    """
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pages.select("doc_id", (F.col("page_index") - 1).alias("position"), F.col(answer).alias("answer"), limit.alias("limit_")).filter("answer in ('yes', 'no')")
    island = rows.withColumn("island_", F.sum(F.when(F.col("answer") == "no", 1).otherwise(0)).over(w)).filter("answer = 'yes'")
    opening = F.min("position").over(Window.partitionBy("doc_id", "island_"))
    kept = island.withColumn("first_", opening).filter("first_ < limit_")
    return kept.select("doc_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_")).alias("run"), "position")


def pick_run(runs: DataFrame, has_numbers: DataFrame) -> DataFrame:
    """doc_id, run: the first run that has page numbers (doc_id, run, has_numbers), else the first run."""
    return runs.select("doc_id", "run").distinct().join(has_numbers, ["doc_id", "run"], "left").groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("has_numbers"), F.col("run"))), F.min("run")).alias("run"))


def pack(tokens: Column, most: int = 10_000, overlap: int = 1) -> Column:
    """Chunks of an ordered array of page sizes: array<struct<first, last>>, positions from 0, last exclusive.

    All pages if they fit. Else a page that would take the current chunk over the target opens the next one, which
    begins `overlap` pages earlier. A first page beyond the target leaves an empty first chunk.
    """
    total = F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: s + x)
    target = F.ceil((total / F.ceil(total / most) + most) / 2)
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(empty.alias("out"), F.lit(0).alias("first"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, t: Column) -> Column:
        back = F.greatest(s["i"] - overlap, F.lit(0))
        carried = F.aggregate(F.slice(tokens, back + 1, s["i"] - back), F.lit(0).cast("long"), lambda a, x: a + x)
        over = s["n"] + t > target
        closed = F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["i"].alias("last"))))
        return F.struct(F.when(over, closed).otherwise(s["out"]).alias("out"), F.when(over, back).otherwise(s["first"]).alias("first"), (s["i"] + 1).alias("i"), (F.when(over, carried).otherwise(s["n"]) + t).alias("n"))

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["i"].alias("last"))))

    whole = F.array(F.struct(F.lit(0).alias("first"), F.size(tokens).alias("last")))
    return F.when(total <= most, whole).otherwise(F.aggregate(tokens, start, step, finish))


def chunks(pages: DataFrame, most: int = 10_000, overlap: int = 1) -> DataFrame:
    """doc_id, chunk (from 0), first_page, last_page (from 1; last < first for an empty chunk), n_tokens."""
    sized = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "tokens"))), lambda x: x["tokens"]).alias("t"))
    parts = sized.select("doc_id", "t", F.posexplode(pack(F.col("t"), most, overlap)).alias("chunk", "c"))
    n = F.aggregate(F.slice("t", F.col("c.first") + 1, F.col("c.last") - F.col("c.first")), F.lit(0).cast("long"), lambda s, x: s + x)
    return parts.select("doc_id", "chunk", (F.col("c.first") + 1).alias("first_page"), F.col("c.last").alias("last_page"), n.alias("n_tokens"))


def chunk_texts(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, chunk, text: the tagged pages of each chunk in order."""
    rows = parts.withColumn("page_index", F.explode(F.when(F.col("last_page") >= F.col("first_page"), F.sequence("first_page", "last_page"))))
    tagged = rows.join(pages, ["doc_id", "page_index"]).withColumn("tagged", wrap_page("page_index", "text"))
    return tagged.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "tagged"))), lambda x: x["tagged"]), "").alias("text"))


def between(paged: Column | str, first: Column, last: Column) -> Column:
    """The pages from first to last (from 1; those that exist) of an array of all pages of a document."""
    low = F.greatest(first, F.lit(1)).cast("int")
    return F.slice(paged, low, F.greatest(last.cast("int") - low + 1, F.lit(0)))


def tagged(paged: Column | str, first: Column, last: Column) -> Column:
    """The tagged text of `between`."""
    low = F.greatest(first, F.lit(1)).cast("int")
    return F.array_join(F.transform(between(paged, first, last), lambda text, i: wrap_page(low + i, text)), "")


def in_range(df: DataFrame, page: str, n_pages: str) -> DataFrame:
    """Rows whose page exists."""
    return df.filter(F.col(page).between(F.lit(1), F.col(n_pages)))


def selected(selection: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen pages (doc_id, page_index) that exist, and those that do not."""
    keys = ["doc_id", "page_index"]
    return pages.join(selection.select(*keys).distinct(), keys, "left_semi"), selection.join(pages.select(*keys), keys, "left_anti")
