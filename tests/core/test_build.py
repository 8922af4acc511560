import os
import random

from quirework.operators import pages as P
from quirework.operators import tree
from quirework.plans import build, enrich
from quirework.provider import RuleProvider

BODY = "many words that do not look like a heading at all because there are more than eight"


def test_build_makes_summarised_trees(spark, tmp_path):
    text = "\n".join(["Intro", BODY + ". Then more.", "Methods here", BODY, "Results"])
    docs = spark.createDataFrame([(1, text), (2, BODY), (3, None), (4, "")], "doc_id long, text string")
    nodes = build.build(docs, RuleProvider(), str(tmp_path)).cache()
    rows = {(r.doc_id, r.node_id): r for r in nodes.collect()}
    one = [(rows[k].title, rows[k].start_index, rows[k].end_index) for k in sorted(rows) if k[0] == 1]
    assert one == [("Intro", 1, 2), ("Methods here", 3, 4), ("Results", 5, 5)]
    assert rows[1, "0000"].summary.startswith("Intro") and rows[2, "0000"].title == "Document"
    assert {k[0] for k in rows} == {1, 2}
    assert tree.leaves(nodes).count() == nodes.count()


def test_contents_with_page_numbers_are_moved_by_their_offset(spark, tmp_path):
    pages = ["Contents\nAlpha 1\nBeta 2\nGamma 3", f"Alpha\n{BODY}", f"Beta\n{BODY}", f"Gamma\n{BODY}"]
    docs = spark.createDataFrame([(1, "\f".join(pages))], "doc_id long, text string")
    rows = build.build(docs, RuleProvider(), str(tmp_path), separator="\f").orderBy("node_id").collect()
    assert [(r.title, r.start_index, r.end_index) for r in rows] == [("Preface", 1, 1), ("Alpha", 2, 2), ("Beta", 3, 3), ("Gamma", 4, 4)]


def test_texts_are_written_once_and_lie_by_document(spark, tmp_path):
    r = random.Random(3)
    line = lambda: "Words. " + " ".join(f"{r.getrandbits(64):x}" for _ in range(9))
    texts = ["\n".join(["Intro", *(line() for _ in range(300)), "Results", line()]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert build.build(docs, RuleProvider(), str(tmp_path)).count() == 40
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path) for f in files)
    assert size < 2 * sum(map(len, texts))
    run = build.Build(docs, RuleProvider(), str(tmp_path / "again"))
    plan = run.beside(run.n_pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort [" not in plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_texts_of_whole_documents_equal_those_of_pages(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nd"), (2, "x")], "doc_id long, text string")
    ranges = [(i, j) for i in range(-1, 6) for j in range(-1, 7)]
    nodes = spark.createDataFrame([(d, f"{k:04d}", i, j) for d in (1, 2) for k, (i, j) in enumerate(ranges)], "doc_id long, node_id string, start_index int, end_index int")
    paged = docs.selectExpr("doc_id", "split(text, '\n') as pages")
    for overlap in (0, 1, 2):
        got = sorted(tree.paged_texts(nodes, paged, overlap).collect())
        assert got == sorted(tree.node_texts(nodes, P.pages_of(docs), overlap).collect()) and len(got) == 2 * len(ranges)


class Misplaced(RuleProvider):
    """Finds every heading two pages late, once of three times, and mends it when asked."""

    def _headings(self, text):
        return [(str(int(n) + 2) if t == "Beta" else n, t) for n, t in super()._headings(text)]


def test_failing_indices_are_fixed_and_checked_again(spark, tmp_path):
    pages = [f"{t}\n{BODY}" for t in ("Alpha", "Beta", "Gamma", "Delta", "Omega")]
    docs = spark.createDataFrame([(1, "\f".join(pages))], "doc_id long, text string")
    rows = build.build(docs, Misplaced(), str(tmp_path), separator="\f").collect()
    assert {r.title: r.start_index for r in rows} == {"Alpha": 1, "Beta": 2, "Gamma": 3, "Delta": 4, "Omega": 5}


class Vision(RuleProvider):
    def reply(self, prompt, inputs, temperature=0.0):
        if prompt == "ocr":
            if "bad" in inputs["content"]:
                raise RuntimeError("no image")
            return f'<analyze>[{{"titles":"{inputs["content"]}"}}]</analyze><table><tr>NaPF6</tr></table>', "finished"
        if prompt == "figure_aware_resummarize":
            return f"{inputs['title']} with {inputs['figure_block'].count('type=')} figures", "finished"
        if prompt == "summarize_from_children":
            return f"{inputs['title']}: " + inputs["child_summaries"].replace("\n", " "), "finished"
        if prompt == "verify_node_summary":
            return '{"faithful": "no", "missed_topics": ["x"]}' if inputs["summary"] == "poor" else '{"faithful": "yes"}', "finished"
        if prompt == "regenerate_summary_with_missed_topics":
            return f"better, with {inputs['missed_topics']}", "finished"
        return super().reply(prompt, inputs, temperature)


NODES = "doc_id long, list_index int, parent_index int, preorder int, depth int, node_id string, title string, start_index int, end_index int, summary string"


def test_elements_and_summaries(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, None, 0, 0, "0000", "Top", 1, 3, "old"), (1, 1, 0, 1, 1, "0001", "A", 1, 1, "a"), (1, 2, 0, 2, 1, "0002", "B", 2, 3, None)], NODES)
    found = [(1, "tbl_1", "table", 1, "good", "cap"), (1, "fig_1", "figure", 1, "bad", None), (1, "fig_2", "figure", 9, "good", None), (1, "fig_3", "figure", 2, None, "in diglyme")]
    elements = spark.createDataFrame(found, "doc_id long, element_id string, label string, page_index int, asset_path string, caption string")
    known = enrich.recognised(elements, Vision(), str(tmp_path / "a"))
    seen = {r.element_id: r for r in known.collect()}
    assert seen["fig_1"].ocr_text == "ERROR: no reply" and seen["fig_1"].ocr_parsed is None and seen["fig_3"].ocr_text is None
    assert seen["tbl_1"].ocr_parsed.format == "figure_analysis" and seen["tbl_1"].ocr_parsed.panels == [{"title": '"good"'}]
    placed = enrich.assigned(known, nodes).cache()
    at = {r.element_id: r for r in placed.collect()}
    assert {k: r.node_id for k, r in at.items()} == {"tbl_1": "0001", "fig_1": "0001", "fig_3": "0002"}
    assert at["tbl_1"].structured_data == "<table><tr>NaPF6</tr></table>" and "NaPF6" in at["tbl_1"].chem_entities and at["fig_3"].chem_entities == ["diglyme"]
    new = {r.node_id: r.summary for r in enrich.resummarised(nodes, placed, Vision(), str(tmp_path / "b")).collect()}
    assert new == {"0000": "Top: [0001] A A with 2 figures  [0002] B B with 1 figures", "0001": "A with 2 figures", "0002": "B with 1 figures"}
    texts = spark.createDataFrame([(1, "0000", "t", "text", "poor"), (1, "0001", "t", "text", "good"), (1, "0002", "t", None, "poor"), (1, "0003", "t", "text", None)], "doc_id long, node_id string, title string, text string, summary string")
    checked = {r.node_id: r.summary for r in enrich.verified(texts, Vision(), str(tmp_path / "c")).collect()}
    assert checked == {"0000": 'better, with ["x"]', "0001": "good", "0002": "poor", "0003": None}
    assert enrich.described(nodes, Vision(), str(tmp_path / "d")).count() == 1
