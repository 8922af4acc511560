"""Detected page elements: filters, boxes, identifiers and captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT, CAPTIONS = ("figure", "table", "isolate_formula"), ("figure_caption", "table_caption")
TEXT_LABELS = ("title", "plain text", "figure_caption", "table_caption", "table_footnote", "formula_caption")
PREFIX = {"figure": "fig", "table": "tbl", "isolate_formula": "eq"}
BOX = ("x0", "y0", "x1", "y1")


def wanted(detections: DataFrame, classes: Sequence[str] | None = None, confidence: float = 0.25, without: Sequence[str] = ()) -> DataFrame:
    """Detections of the classes (all if None) but those in `without`, with at least that confidence."""
    cond = F.col("confidence") >= confidence
    if classes is not None:
        cond &= F.col("label").isin(*classes)
    return detections.filter(cond & ~F.col("label").isin(*without) if without else cond)


def split_text(regions: DataFrame, labels: Sequence[str] = TEXT_LABELS) -> DataFrame:
    """Adds kind: text or non_text."""
    return regions.withColumn("kind", F.when(F.col("label").isin(*labels), "text").otherwise("non_text"))


def normalized(width: Column | str, height: Column | str) -> Column:
    """struct<x0, y0, x1, y1> of the box columns as shares of the page's width and height."""
    w, h = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    return F.struct(*((F.col(c) / (w if c[0] == "x" else h)).alias(c) for c in BOX))


def scaled(ocr_dpi: int = 300, dpi: int = 200) -> Column:
    """struct<x0, y0, x1, y1> of the box columns at another resolution, cut down to whole pixels."""
    return F.struct(*((F.col(c) * (ocr_dpi / dpi)).cast("int").alias(c) for c in BOX))


def points(dpi: int = 200) -> Column:
    """struct<x0, y0, x1, y1> of the box columns in points."""
    return F.struct(*((F.col(c) * 72 / dpi).alias(c) for c in BOX))


def with_ids(elements: DataFrame, order: str = "det_index", node: str = "doc") -> DataFrame:
    """Adds element_id `<prefix>_<node>_<page>_<n>`; n counts from 1 by page and label in detection order."""
    prefix = F.lit("el")
    for label, p in PREFIX.items():
        prefix = F.when(F.col("label") == label, p).otherwise(prefix)
    n = F.row_number().over(Window.partitionBy("doc_id", "page_index", "label").orderBy(order))
    return elements.withColumn("element_id", F.format_string(f"%s_{node}_%04d_%03d", prefix, "page_index", n))


def file_numbers(regions: DataFrame, order: str = "det_index") -> DataFrame:
    """Adds file_number: from 0 by page and label, and empty crops left out."""
    some = regions.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return some.withColumn("file_number", F.row_number().over(Window.partitionBy("doc_id", "page_index", "label").orderBy(order)) - 1)


def counts(elements: DataFrame) -> DataFrame:
    """doc_id, one row: elements by type, captions with text, pages with elements, all elements."""
    return elements.groupBy("doc_id").agg(*(F.count_if(F.col("label") == x).alias(f"n_{x}") for x in CONTENT), F.count_if(F.coalesce(F.length("caption"), F.lit(0)) > 0).alias("n_captions"), F.countDistinct("page_index").alias("pages_with_elements"), F.count("*").alias("n_elements"))


def region_counts(regions: DataFrame) -> DataFrame:
    """Text and other regions by image and method."""
    return regions.groupBy("image", "method").agg(F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind") == "non_text").alias("n_non_text"))


def captions(detections: DataFrame, vertical: int = 80, ratio: float = 0.6) -> DataFrame:
    """doc_id, page_index, det_index, caption_index (null without): the nearest free caption of every content element.

    Contents choose in detection order; a caption serves once, whatever its type, and those with one det_index are
    one in this: when one is taken, so are the others. Its centre must lie within
    `ratio` of the content's width, and it must start at most `vertical` below the content, or, failing that, end at
    most as far above it. The first of equally near captions wins. A page's detections are one group.
    """
    box = F.struct("det_index", *BOX)
    of = lambda labels: F.array_sort(F.collect_list(F.when(F.col("label").isin(*labels), box)))
    pages = detections.filter(F.col("label").isin(*CONTENT, *CAPTIONS)).groupBy("doc_id", "page_index").agg(of(CONTENT).alias("contents"), of(CAPTIONS).alias("captions"))

    def choice(e: Column, used: Column) -> Column:
        """Place of the nearest free caption of e, the first with its det_index; null without."""

        def gap(c: Column) -> Column:
            below, above = c["y0"] - e["y1"], e["y0"] - c["y1"]
            near = F.abs(e["x0"] + e["x1"] - c["x0"] - c["x1"]) / 2 <= (e["x1"] - e["x0"]) * ratio
            return F.when(near, F.when(below.between(0, vertical), below).when(above.between(0, vertical), above))

        first = lambda c: (F.array_position(F.col("captions")["det_index"], c["det_index"]) - 1).cast("int")
        gaps = F.transform("captions", lambda c: F.struct(F.when(~F.array_contains(used, first(c)), gap(c)).alias("gap"), first(c).alias("at")))
        return F.array_min(F.filter(gaps, lambda g: g["gap"].isNotNull()))["at"]

    # the places of the captions taken so far, one for each content in order, -1 where there was none
    taken = F.aggregate("contents", F.array().cast("array<int>"), lambda used, e: F.concat(used, F.array(F.coalesce(choice(e, used), F.lit(-1)))))
    pairs = pages.select("doc_id", "page_index", "captions", F.explode(F.arrays_zip("contents", taken.alias("taken"))).alias("x"))
    return pairs.select("doc_id", "page_index", F.col("x.contents.det_index").alias("det_index"), F.get("captions", F.col("x.taken"))["det_index"].cast("long").alias("caption_index"))


def drop_unplaced(elements: DataFrame, page_nodes: DataFrame) -> DataFrame:
    """Elements with their page's node; elements on pages without one are left out."""
    return elements.join(page_nodes, ["doc_id", "page_index"])


def to_recognise(elements: DataFrame, enabled: bool = True) -> DataFrame:
    """Elements that are sent to recognition: those with an image, if it is switched on at all."""
    return elements.filter(F.lit(enabled) & (F.coalesce(F.length("asset_path"), F.lit(0)) > 0))
