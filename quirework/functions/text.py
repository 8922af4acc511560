"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: runs of non-white-space, in ASCII's sense
WORD = r"[^\x20\x09-\x0D]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(c), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def count_words(c: Column | str) -> Column:
    """Words; 0 for null and empty text. The default token counter."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(WORD)), F.lit(0))


def token_counter(encode: Callable[[str], list] | None = None) -> Callable[[Column | str], Column]:
    """A token counter: the words counter, or one that counts what `encode` returns (run on Arrow batches)."""
    if encode is None:
        return count_words
    import pandas as pd

    def count(texts):
        return texts.map(lambda t: len(encode(t)) if t else 0)

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    counted = F.pandas_udf(count, "int")
    return lambda c: counted(_c(c))


def page_tag_number(c: Column | str) -> Column:
    """`<physical_index_N>` or `physical_index_N` -> N; anything else -> null."""
    c = _c(c)
    return F.when(c.startswith("<physical_index_") | c.startswith("physical_index_"), strip(F.rtrim(F.element_at(F.split(c, "_"), -1), F.lit(">"))).try_cast("int"))


def page_tag_or_text(c: Column | str) -> Column:
    """As page_tag_number where the text is a tag; other texts stay as they are (the list form)."""
    c = _c(c)
    return F.when(c.startswith("<physical_index_") | c.startswith("physical_index_"), page_tag_number(c).cast("string")).otherwise(c)


def page_number(c: Column | str) -> Column:
    """A page label as int, null if it is no number; the label itself stays in its own column."""
    return strip(c).try_cast("int")


def wrap_page(index: Column | str, text: Column | str) -> Column:
    """Text between two equal page tags."""
    return F.format_string("<physical_index_%d>\n%s\n<physical_index_%d>\n\n", _c(index), _c(text), _c(index))


def clean_dot_leaders(c: Column | str) -> Column:
    """Five and more dots, close together or spaced, become a colon."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def strip_thinking(c: Column | str) -> Column:
    """Without <think> blocks, trimmed."""
    return strip(F.regexp_replace(_c(c), r"(?s)<think>.*?</think>", ""))


def fence_content(c: Column | str) -> Column:
    """From after the first json fence, if any, up to the last fence, if any; trimmed."""
    c = _c(c)
    at = F.locate("```json", c)
    body = F.when(at > 0, F.substring(c, at + 7, F.length(c))).otherwise(c)
    fences = F.size(F.split(body, "```")) - 1
    return strip(F.when(fences > 0, F.array_join(F.slice(F.split(body, "```"), 1, fences), "```")).otherwise(body))


def strip_tags(c: Column | str) -> Column:
    """Each tag becomes a space; white space collapses; trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(_c(c), r"<[^>]+>", " "), r"[\x20\x09-\x0D]+", " "))


def parse_bbox(c: Column | str) -> Column:
    """Exactly four unsigned integers -> array<int>, else null."""
    c = _c(c)
    four = r"^[\x20\x09-\x0D]*[0-9]+([\x20\x09-\x0D]+[0-9]+){3}[\x20\x09-\x0D]*$"
    return F.when(c.rlike(four), F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")))


def render_tag(name: Column | str, attributes: Column | str) -> Column:
    """An opening tag from a map of attributes; those with null values are left out."""
    kept = F.map_entries(F.map_filter(_c(attributes), lambda k, v: v.isNotNull()))
    return F.concat(F.lit("<"), _c(name), F.array_join(F.transform(kept, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), e["value"], F.lit('"'))), ""), F.lit(">"))


def first_table(c: Column | str) -> Column:
    """The first HTML table, null without one."""
    return F.nullif(F.regexp_extract(_c(c), r"(?is)<table.*?</table>", 0), F.lit(""))


def join_texts(*cs: Column | str) -> Column:
    """Non-empty texts joined by a space."""
    return F.concat_ws(" ", *(F.nullif(_c(c), F.lit("")) for c in cs))


def section_content(c: Column | str, start: str = "<<<section-content>>>", stop: str = "<<<context-after>>>") -> Column:
    """What stands between two markers, trimmed; the whole text without the first, all the rest without the second."""
    c = _c(c)
    at = F.locate(start, c)
    rest = F.substring(c, at + len(start), F.length(c))
    end = F.locate(stop, rest)
    return F.when(at == 0, c).otherwise(strip(F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)))


def element_block(ident: Column | str, kind: Column | str, page: Column | str, caption: Column | str, ocr: Column | str, chem: Column | str) -> Column:
    """A header line, and lines for caption, recognised text and entities (array) where they are there."""
    line = lambda label, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"  {label}: "), c))
    header = F.format_string("[%s] type=%s, page=%s", _c(ident), _c(kind), _c(page).cast("string"))
    return F.concat_ws("\n", header, line("caption", _c(caption)), line("ocr_text", _c(ocr)), line("chem_entities", F.array_join(_c(chem), ", ")))


def child_block(ident: Column | str, title: Column | str, summary: Column | str) -> Column:
    """A child's id, title and summary for its parent; blocks are joined by an empty line."""
    return F.concat(F.lit("["), _c(ident), F.lit("] "), _c(title), F.lit("\n"), F.coalesce(F.nullif(_c(summary), F.lit("")), F.lit("(no summary)")))


def result_name_part(name: Column | str, part: str) -> Column:
    """One key of `<pdf_stem>_p<page>_<img>_<model>_<task>.md`: greedy from the left; null if the name has another form."""
    at = ["pdf_stem", "page", "img", "model", "task"].index(part) + 1
    return F.nullif(F.regexp_extract(_c(name), r"^(.+)_p(\d+)_(.+)_([^_]+)_([^_]+)\.md$", at), F.lit(""))


def image_type(path: Column | str) -> Column:
    """MIME type by suffix."""
    suffix = F.lower(F.element_at(F.split(_c(path), r"\."), -1))
    return F.concat(F.lit("image/"), F.when(suffix == "jpg", "jpeg").otherwise(suffix))


def escape_html(c: Column | str, apostrophe: str = "&#x27;") -> Column:
    """& < > " ' as entities."""
    out = _c(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def linear_rows(c: Column | str) -> Column:
    """A linearized table as array of rows of trimmed cells, the first being the header; null with fewer than two rows."""
    rows = F.split(strip(F.replace(_c(c), F.lit("<0x0A>"), F.lit("\n"))), "\n")
    return F.when(F.size(rows) >= 2, F.transform(rows, lambda r: F.transform(F.split(r, r" \| "), strip)))


def drop_dead_images(c: Column | str) -> Column:
    """Image tags without a source become an aside with their alt text, or nothing without one."""
    dead = r"(?is)<img\b(?![^>]*\bsrc\s*=)[^>]*"
    aside = F.regexp_replace(_c(c), dead + r'\balt\s*=\s*(?:"([^"]+)"|\'([^\']+)\')[^>]*>', '<aside class="img-desc">$1$2</aside>')
    return F.regexp_replace(aside, dead + ">", "")


def cap(c: Column | str, most: int = 2000) -> Column:
    """At most so many characters, and a note of how many were left out."""
    c = _c(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n…[truncated, "), (F.length(c) - most).cast("string"), F.lit(" more chars]"))).otherwise(c)


def asset_url(c: Column | str) -> Column:
    """From the first /kb/ on; unchanged without it; empty for null."""
    c = F.coalesce(_c(c), F.lit(""))
    at = F.locate("/kb/", c)
    return F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)


def math_spans(c: Column | str) -> Column:
    """Contents of $$…$$, then of one-line $…$ in what remains."""
    c = _c(c)
    display = r"(?s)\$\$(.+?)\$\$"
    return F.concat(F.regexp_extract_all(c, F.lit(display), F.lit(1)), F.regexp_extract_all(F.regexp_replace(c, display, " "), F.lit(r"\$([^$\n]+?)\$"), F.lit(1)))


def slug(c: Column | str, by: str = "_") -> Column:
    """Spaces as `by`."""
    return F.replace(_c(c), F.lit(" "), F.lit(by))


def finish_reason(c: Column | str) -> Column:
    """A provider's stop reason: cut off or finished."""
    return F.when(_c(c).isin("max_tokens", "length"), "max_output_reached").otherwise("finished")
