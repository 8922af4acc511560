"""Recognition results: keys from file names, groups, and series of data points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import result_name_part

KEYS = ("pdf_stem", "page", "img", "model", "task")


def with_keys(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds the keys in a result's file name; files with other names are left out."""
    return files.withColumns({k: result_name_part(name, k) for k in KEYS}).filter(F.col("pdf_stem").isNotNull())


def batch_name(path: str = "path", model: str = "model", task: str = "task"):
    """The name under which a batch stores an image's result, from the path's parts."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.concat_ws("_", F.element_at(parts, -5), F.concat(F.lit("p"), F.regexp_replace(F.element_at(parts, -4), r"^\D*", "")), stem, F.col(model), F.concat(F.col(task), F.lit(".md")))


def grouped(results: DataFrame, name: str = "name") -> DataFrame:
    """pdf_stem, page, img, members (name, model, task in order of file names)."""
    return results.groupBy("pdf_stem", "page", "img").agg(F.array_sort(F.collect_list(F.struct(name, "model", "task"))).alias("members"))


def with_images(groups: DataFrame, images: DataFrame) -> DataFrame:
    """Groups with their source image (pdf_stem, page, img, suffix, path), png before jpg; groups without are left out."""
    best = images.filter(F.col("suffix").isin("png", "jpg")).groupBy("pdf_stem", "page", "img").agg(F.min_by("path", F.when(F.col("suffix") == "png", 0).otherwise(1)).alias("image"))
    return groups.join(best, ["pdf_stem", "page", "img"])


def series_points(points: DataFrame) -> DataFrame:
    """key, series, column, row, cell of figure points (key, point_index, point as map): one cell for each column of the key's table.

    A point without a series belongs to `data`. Columns are the keys of all points in first-seen order without
    series and panel; a missing cell is empty.
    """
    named = points.withColumn("series", F.coalesce(F.col("point")["series"], F.lit("data")))
    seen = named.select("key", "point_index", F.posexplode(F.map_keys("point")).alias("k", "column")).filter(~F.col("column").isin("series", "panel"))
    columns = seen.groupBy("key", "column").agg(F.min(F.struct("point_index", "k")).alias("first_seen"))
    rows = named.withColumn("values_", F.col("point")).select("key", "series", "point_index", "values_")
    return rows.join(columns, "key").select("key", "series", "column", "first_seen", "point_index", F.coalesce(F.try_element_at("values_", F.col("column")), F.lit("")).alias("cell"))


def series_tables(points: DataFrame) -> DataFrame:
    """key, series, columns, rows (arrays of cells) of the tables that series_points describes."""
    cells = series_points(points)
    rows = cells.groupBy("key", "series", "point_index").agg(F.array_sort(F.collect_list(F.struct("first_seen", "column", "cell"))).alias("r"))
    return rows.groupBy("key", "series").agg(
        F.min_by(F.transform("r", lambda x: x["column"]), "point_index").alias("columns"),
        F.transform(F.array_sort(F.collect_list(F.struct("point_index", F.transform("r", lambda x: x["cell"]).alias("cells")))), lambda x: x["cells"]).alias("rows"),
    )
