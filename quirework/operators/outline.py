"""Outlines: rows of (doc_id, list_index, structure, title, page, physical_index, has_physical_index, appear_start)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order():
    return Window.partitionBy("doc_id").orderBy("list_index")


def _earlier():
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


def _later():
    return _in_order().rowsBetween(1, Window.unboundedFollowing)


def located(outline: DataFrame) -> DataFrame:
    """Items with a physical index."""
    return outline.filter("physical_index is not null")


def drop_beyond(outline: DataFrame, n_pages: Column | str, start: int = 1) -> DataFrame:
    """Physical indices past the last page become null; rows stay, and there is no lower bound."""
    n = F.col(n_pages) if isinstance(n_pages, str) else n_pages
    return outline.withColumn("physical_index", F.when(F.col("physical_index") <= n + start - 1, F.col("physical_index")))


def match_titles(outline: DataFrame, indexed: DataFrame, start_page: int) -> DataFrame:
    """doc_id, title, page, physical_index of items with equal titles (null equals null) whose index is start_page or later.

    pos_ orders the pairs: by the indexed outline, then the outline. Repeated titles multiply.
    """
    left = outline.select("doc_id", F.col("title").alias("lt"), "page", F.col("list_index").alias("li"))
    right = indexed.filter(F.col("physical_index") >= start_page).select(F.col("doc_id").alias("rd"), "title", "physical_index", F.col("list_index").alias("ri"))
    pairs = left.join(right, (F.col("doc_id") == F.col("rd")) & F.col("lt").eqNullSafe(F.col("title")))
    return pairs.select("doc_id", "title", "page", "physical_index", F.struct("ri", "li").alias("pos_"))


def page_offset(pairs: DataFrame) -> DataFrame:
    """doc_id, page_offset: the most frequent physical_index - page; of equally frequent ones the first seen."""
    diffs = pairs.withColumn("d", F.col("physical_index") - F.col("page")).filter("d is not null")
    counted = diffs.groupBy("doc_id", "d").agg(F.count("*").alias("n"), F.min("pos_").alias("first_"))
    return counted.groupBy("doc_id").agg(F.min_by("d", F.struct((-F.col("n")).alias("n"), "first_")).alias("page_offset"))


def apply_offset(outline: DataFrame, offsets: DataFrame) -> DataFrame:
    """physical_index = page + offset where there is a page; page becomes null there. Without an offset nothing changes."""
    rows = outline.join(offsets, "doc_id", "left")
    moved = F.col("page").isNotNull() & F.col("page_offset").isNotNull()
    names = outline.columns
    out = rows.withColumns({"physical_index": F.when(moved, F.col("page") + F.col("page_offset")).otherwise(F.col("physical_index")), "has_physical_index": moved | F.col("has_physical_index"), "page": F.when(~moved, F.col("page"))})
    return out.select(*names)


def anchors(outline: DataFrame) -> DataFrame:
    """Adds previous and following known index of each item: 0 and -1 where there is none."""
    return outline.withColumns({"previous": F.coalesce(F.last("physical_index", True).over(_earlier()), F.lit(0)), "following": F.coalesce(F.first("physical_index", True).over(_later()), F.lit(-1))})


def missing_items(outline: DataFrame) -> DataFrame:
    """Items whose index is absent (not: present and null), with their anchors."""
    return anchors(outline).filter("not has_physical_index")


def correct_anchors(outline: DataFrame, failing: Column | str, n_pages: Column | str, start: int = 1) -> DataFrame:
    """Adds previous and following index among items that did not fail: start - 1 and the last page where there is none."""
    bad = F.col(failing) if isinstance(failing, str) else failing
    n = F.col(n_pages) if isinstance(n_pages, str) else n_pages
    good = F.when(~F.coalesce(bad, F.lit(False)), F.col("physical_index"))
    rows = outline.withColumn("good_", good)
    return rows.withColumns({"previous": F.coalesce(F.last("good_", True).over(_earlier()), F.lit(start - 1)), "following": F.coalesce(F.first("good_", True).over(_later()), n + start - 1)}).drop("good_")


def write_back(outline: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outline with the valid corrections (doc_id, list_index, physical_index, is_valid), and the corrections that stay invalid."""
    keys = ["doc_id", "list_index"]
    valid = fixed.filter("is_valid").select(*keys, F.col("physical_index").alias("fixed_"))
    out = outline.join(valid, keys, "left").withColumn("physical_index", F.coalesce("fixed_", "physical_index")).drop("fixed_")
    return out, fixed.filter("not is_valid").unionByName(fixed.filter("is_valid").join(outline.select(*keys), keys, "left_anti"))


def with_preface(outline: DataFrame) -> DataFrame:
    """A `Preface` item (structure 0, page 1, list_index -1) before outlines whose first item comes after page 1."""
    first = outline.groupBy("doc_id").agg(F.min_by("physical_index", "list_index").alias("f")).filter("f > 1")
    values = {"list_index": F.lit(-1), "structure": F.lit("0"), "title": F.lit("Preface"), "physical_index": F.lit(1), "has_physical_index": F.lit(True)}
    row = [values.get(c, F.lit(None)).cast(outline.schema[c].dataType).alias(c) if c != "doc_id" else F.col("doc_id") for c in outline.columns]
    return outline.unionByName(first.select(*row))


def section_ranges(outline: DataFrame, n_pages: Column | str) -> DataFrame:
    """Adds start_index and end_index: up to the next item's page, or the page before where that item opens its page.

    The last item ends with the document. An end can be smaller than its start.
    """
    n = F.col(n_pages) if isinstance(n_pages, str) else n_pages
    nxt, opens = F.lead("physical_index").over(_in_order()), F.lead("appear_start").over(_in_order())
    last = F.lead("list_index").over(_in_order()).isNull()
    return outline.withColumns({"start_index": F.col("physical_index"), "end_index": F.when(last, n).when(opens == "yes", nxt - 1).otherwise(nxt)})


def verification(outline: DataFrame, n_pages: Column | str, answer: str = "answer") -> DataFrame:
    """doc_id, accuracy (share of `yes` among located items), failures (list indices, ascending).

    Accuracy 0 and no failures where the last known index is missing or before the middle of the document.
    """
    n = F.col(n_pages) if isinstance(n_pages, str) else n_pages
    known = F.col("physical_index").isNotNull()
    out = outline.withColumn("n_", n).groupBy("doc_id").agg(
        F.max_by(F.when(known, F.col("physical_index")), F.when(known, F.col("list_index"))).alias("last_"),
        F.max("n_").alias("n_"),
        F.avg(F.when(known, F.when(F.col(answer) == "yes", 1.0).otherwise(0.0))).alias("a_"),
        F.array_sort(F.collect_list(F.when(known & ~F.col(answer).eqNullSafe(F.lit("yes")), F.col("list_index")))).alias("f_"),
    )
    early = F.col("last_").isNull() | (F.col("last_") < F.col("n_") / 2)
    return out.select("doc_id", F.when(early, 0.0).otherwise(F.coalesce("a_", F.lit(0.0))).alias("accuracy"), F.when(early, F.array().cast("array<int>")).otherwise(F.col("f_").cast("array<int>")).alias("failures"))


def route(accuracy: Column | str, n_failures: Column | str) -> Column:
    """What follows a verification: accept, fix, or fall_back to the next mode."""
    a = F.col(accuracy) if isinstance(accuracy, str) else accuracy
    n = F.col(n_failures) if isinstance(n_failures, str) else n_failures
    return F.when((a == 1.0) & (n == 0), "accept").when((a > 0.6) & (n > 0), "fix").otherwise("fall_back")
