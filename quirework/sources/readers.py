"""Sources: page files, images, results, knowledge bases and settings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """doc_id (file stem), path, page_index, text of files below path; `extract` gives a file's page texts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                texts = extract(content)
                yield pd.DataFrame({"path": [p] * len(texts), "page_index": range(1, len(texts) + 1), "text": texts})

    pages = files.mapInPandas(run, "path string, page_index int, text string")
    return pages.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "path", "page_index", "text")


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text file: separated by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def one_source(file: str | None, directory: str | None) -> str:
    """The one of the two that is given."""
    if bool(file) == bool(directory):
        raise ValueError("give either a file or a directory")
    return file or directory


def images(spark: SparkSession, path: str, pattern: str = "page_*.png") -> DataFrame:
    """path, length, content (base64) of image files at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.base64("content").alias("content"))


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """name, text of stored results."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tree (JSON) of the directories with a tree.json, in order of names."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "tree.json").text(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/tree\.json$", 1).alias("doc_id"), F.col("value").alias("tree")).orderBy("doc_id")


def settings(path: str) -> dict:
    """A YAML file of settings, and `_dir`, where it lies."""
    import yaml

    return (yaml.safe_load(Path(path).read_text()) or {}) | {"_dir": str(Path(path).resolve().parent)}


def seeds(path: str) -> list[str]:
    """The seed vocabulary in a YAML file; empty without the file."""
    import yaml

    return (yaml.safe_load(Path(path).read_text()) or {}).get("entities", []) if os.path.exists(path) else []


def resolve_host(explicit: str | None, ip_file: str) -> str:
    """An explicit host, else the one in a file."""
    if explicit:
        return explicit
    if not os.path.exists(ip_file):
        raise FileNotFoundError(ip_file)
    host = Path(ip_file).read_text().strip()
    if not host:
        raise ValueError(f"{ip_file} is empty")
    return host


def resolve_url(url: str, directory: str, scheme: str = "instance") -> str:
    """`scheme://name:port/path` with the host from the file `<name>.ip` in directory; other URLs unchanged."""
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    if parts.scheme != scheme:
        return url
    if not parts.hostname:
        raise ValueError(f"no instance in {url!r}")
    host = resolve_host(None, os.path.join(directory, f"{parts.hostname}.ip"))
    return f"http://{host}" + (f":{parts.port}" if parts.port else "") + parts.path


def contained(root: str, name: str) -> str:
    """The path of a file below root; PermissionError outside it, FileNotFoundError if it is not there."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, name))
    if os.path.commonpath([base, full]) != base:
        raise PermissionError(name)
    if not os.path.isfile(full):
        raise FileNotFoundError(name)
    return full
