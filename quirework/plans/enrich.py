"""From built trees to trees with figures: recognition of element images, elements by node, and summaries that know them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import entities
from ..functions.structured import envelope
from ..functions.text import child_block, section_content, strip
from ..operators import layout, tree
from ..provider import Provider
from .steps import Run


def recognised(elements: DataFrame, provider: Provider, path: str, enabled: bool = True) -> DataFrame:
    """elements (with element_id and asset_path) with ocr_text and ocr_parsed; a failed call leaves `ERROR: no reply` and nothing parsed."""
    run = Run(elements.sparkSession, provider, f"{path}/recognise")
    sent = layout.to_recognise(elements, enabled).select("doc_id", "element_id", "asset_path")
    told = run.asked(sent, "ocr", {"content": "asset_path"}, ["doc_id", "element_id"], json_mode=False)
    failed = F.col("reason") == "error"
    text = F.when(failed, "ERROR: no reply").otherwise(F.col("reply"))
    out = told.select("doc_id", "element_id", text.alias("ocr_text"), F.when(~failed, envelope("reply")).alias("ocr_parsed"))
    return elements.join(run.written(out, "recognised"), ["doc_id", "element_id"], "left")


def assigned(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Recognised elements with node_id, chem_entities and, for tables, structured_data (the first table in the recognised text); pages without a node are left out."""
    placed = elements.join(tree.pages_to_nodes(elements.select("doc_id", "page_index").distinct(), nodes), ["doc_id", "page_index"])
    words = F.concat_ws(" ", F.nullif(F.col("ocr_text"), F.lit("")), F.nullif(F.col("caption"), F.lit("")))
    table = F.nullif(F.regexp_extract("ocr_text", r"(?i)<table[\s\S]*?</table>", 0), F.lit(""))
    return placed.withColumns({"chem_entities": entities(words), "structured_data": F.when(F.col("label") == "table", table)})


def figure_blocks(elements: DataFrame) -> DataFrame:
    """doc_id, node_id, figures: what is known of a node's elements, as text."""
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"  {name}: "), c))
    head = F.format_string("[%s] type=%s, page=%d", "element_id", "label", "page_index")
    block = F.concat_ws("\n", head, line("caption", F.col("caption")), line("ocr_text", F.col("ocr_text")), line("chem_entities", F.array_join("chem_entities", ", ")))
    blocks = elements.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "element_id", block.alias("b")))).alias("x"))
    return blocks.select("doc_id", "node_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("figures"))


def _replaced(nodes: DataFrame, told: DataFrame) -> DataFrame:
    """nodes with the summaries of told (doc_id, node_id, reply, reason) where there was a reply."""
    new = told.filter("reason <> 'error'").select("doc_id", "node_id", strip("reply").alias("new_"))
    return nodes.join(new, ["doc_id", "node_id"], "left").withColumn("summary", F.coalesce("new_", "summary")).drop("new_")


def resummarised(nodes: DataFrame, elements: DataFrame, provider: Provider, path: str) -> DataFrame:
    """nodes with new summaries: leaves with elements from those, then parents from their children, the deepest level first."""
    run = Run(nodes.sparkSession, provider, f"{path}/resummarise")
    keys = ["doc_id", "node_id"]
    figures = tree.leaves(nodes).join(figure_blocks(elements), keys).select(*keys, "title", F.coalesce("summary", F.lit("")).alias("summary"), "figures")
    told = run.asked(figures, "figure_aware_resummarize", {"title": "title", "prior_summary": "summary", "figure_block": "figures"}, keys, json_mode=False)
    current = run.written(_replaced(nodes, told), "with_figures")
    for d in range((nodes.agg(F.max("depth")).first()[0] or 0) - 1, -1, -1):
        block = F.struct("list_index", child_block("node_id", "title", "summary").alias("block"))
        below = current.filter(F.col("depth") == d + 1).groupBy("doc_id", F.col("parent_index").alias("list_index")).agg(F.array_sort(F.collect_list(block)).alias("b"))
        parents = current.filter(F.col("depth") == d).join(below, ["doc_id", "list_index"]).select(*keys, "title", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("children"))
        told = run.asked(parents, "summarize_from_children", {"title": "title", "child_summaries": "children"}, keys, json_mode=False)
        current = run.written(_replaced(current, told), f"level{d}")
    return current


def to_verify(nodes: DataFrame) -> DataFrame:
    """Nodes whose summary can be verified: with a summary and a text."""
    return nodes.filter((F.coalesce(F.length("summary"), F.lit(0)) > 0) & (F.coalesce(F.length("text"), F.lit(0)) > 0))


def missed_topics(json: Column | str) -> Column:
    """The topics that a verification names as missed; empty without. An unfaithful summary without missed topics gives nothing to act on."""
    return F.coalesce(F.from_json(F.get_json_object(json, "$.missed_topics"), "array<string>"), F.array().cast("array<string>"))


def verified(nodes: DataFrame, provider: Provider, path: str) -> DataFrame:
    """nodes (with summary and text) whose summaries were verified, and written once again where topics were missed."""
    run = Run(nodes.sparkSession, provider, f"{path}/verify")
    keys = ["doc_id", "node_id"]
    asked = to_verify(nodes).select(*keys, "title", "text", "summary")
    told = run.asked(asked, "verify_node_summary", {"title": "title", "section_text": section_content("text"), "summary": "summary"}, [*keys, "text", "summary"])
    missed = told.withColumn("missed", missed_topics("json")).filter("size(missed) > 0").select(*keys, "text", "summary", "missed")
    again = run.asked(missed, "regenerate_summary_with_missed_topics", {"node_text": "text", "prior_summary": "summary", "missed_topics": F.to_json("missed")}, keys, json_mode=False)
    return _replaced(nodes, again)


def described(nodes: DataFrame, provider: Provider, path: str) -> DataFrame:
    """doc_id, description: one for each document, from its nodes' titles and summaries."""
    run = Run(nodes.sparkSession, provider, f"{path}/describe")
    trees = tree.to_nested(nodes, tree.DESCRIBED)
    return run.asked(trees, "generate_doc_description", {"structure": "tree"}, ["doc_id"], json_mode=False).select("doc_id", F.col("reply").alias("description"))
