import json

import pytest
from pyspark.sql import functions as F

from quirework import provider as P
from quirework.functions import entities as E
from quirework.functions import structured as X
from quirework.functions import text as T
from quirework.operators import layout, metrics, outline, pages, results, tree
from quirework.sources import readers, writers
from quirework.streaming import ingest


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column("c").alias("r")).first().r


PAGES = "doc_id long, page_index int, text string, tokens int"


def sized(spark, tokens):
    return spark.createDataFrame([(1, i + 1, f"p{i + 1}", t) for i, t in enumerate(tokens)], PAGES)


@pytest.mark.parametrize(
    ("tokens", "want"),
    [([4000, 4000], [(1, 2)]), ([4000] * 4, [(1, 2), (2, 3), (3, 4)]), ([12000, 1000], [(1, 0), (1, 1), (1, 2)]), ([0], [(1, 1)])],
)
def test_chunks(spark, tokens, want):
    assert [(r.first_page, r.last_page) for r in pages.chunks(sized(spark, tokens)).orderBy("chunk").collect()] == want


def test_chunk_texts(spark):
    p = sized(spark, [4000] * 4)
    texts = {r.chunk: r.text for r in pages.chunk_texts(p, pages.chunks(p)).collect()}
    assert texts[1] == "<physical_index_2>\np2\n<physical_index_2>\n\n<physical_index_3>\np3\n<physical_index_3>\n\n"


@pytest.mark.parametrize(
    ("answers", "limit", "want"),
    [("no yes yes no yes", 3, [1, 2]), ("no no yes yes no", 3, [2, 3]), ("no no no yes", 3, []), ("yes maybe yes no", 3, [0, 2])],
)
def test_contents_run(spark, answers, limit, want):
    p = spark.createDataFrame([(1, i + 1, a) for i, a in enumerate(answers.split())], "doc_id long, page_index int, answer string")
    assert sorted(r.position for r in pages.contents_run(p, "answer", F.lit(limit)).collect()) == want


@pytest.mark.parametrize(("words", "want"), [([10, 20, 40, 50], (40, False)), ([10, 20, 29], (20, True)), ([30], (30, False))])
def test_scanned(spark, words, want):
    p = spark.createDataFrame([(1, i + 1, " ".join(["w"] * n), n) for i, n in enumerate(words)], PAGES)
    assert tuple(pages.likely_scanned(p).first())[1:] == want


OUTLINE = "doc_id long, list_index int, structure string, title string, page int, physical_index int, has_physical_index boolean, appear_start string"


def items(spark, rows):
    return spark.createDataFrame([(1, i, s, t, p, n, n is not None, a) for i, (s, t, p, n, a) in enumerate(rows)], OUTLINE)


def test_section_ranges_and_tree(spark):
    o = items(spark, [("1", "a", None, 1, "yes"), ("2", "b", None, 3, "no"), ("3", "c", None, 5, "yes")])
    ranged = outline.section_ranges(o, F.lit(8))
    assert [(r.start_index, r.end_index) for r in ranged.orderBy("list_index").collect()] == [(1, 3), (3, 4), (5, 8)]
    nodes = tree.build(ranged)
    p = sized(spark, [1] * 9)
    held = {r.page_index: r.node_id for r in tree.pages_to_nodes(p, nodes).collect()}
    assert held == {1: "0000", 2: "0000", 3: "0001", 4: "0001", 5: "0002", 6: "0002", 7: "0002", 8: "0002"}
    text = {r.node_id: r.text for r in tree.node_texts(nodes, p, 1).collect()}
    assert text["0001"] == "<<<context-before>>>\np2\n<<<section-content>>>\np3p4\n<<<context-after>>>\np5"
    shared = outline.section_ranges(items(spark, [("1", "a", None, 4, "yes"), ("2", "b", None, 4, "yes")]), F.lit(8))
    assert [(r.start_index, r.end_index) for r in shared.orderBy("list_index").collect()] == [(4, 3), (4, 8)]


def test_tree_codes(spark):
    o = items(spark, [(c, c, None, 1, "no") for c in ("1", "1.1", "2.1", "2", "2.2")])
    nodes = {r.structure: (r.node_id, r.parent_index, r.depth) for r in tree.build(outline.section_ranges(o, F.lit(3))).collect()}
    assert nodes == {"1": ("0000", None, 0), "1.1": ("0001", 0, 1), "2.1": ("0002", None, 0), "2": ("0003", None, 0), "2.2": ("0004", 3, 1)}
    nested = json.loads(tree.to_nested(tree.build(outline.section_ranges(o, F.lit(3)))).first().tree)
    assert [n["title"] for n in nested] == ["1", "2.1", "2"] and [n["title"] for n in nested[2]["nodes"]] == ["2.2"]


@pytest.mark.parametrize(("diffs", "want"), [([2, 3, 3, 2], 2), ([3, 2, 2, 3], 3), ([], None)])
def test_offset_is_the_first_of_the_most_frequent(spark, diffs, want):
    o = items(spark, [(str(i), f"t{i}", 10, 10 + d, "no") for i, d in enumerate(diffs)])
    found = outline.page_offset(outline.match_titles(o, o, 1)).collect()
    assert (found[0].page_offset if found else None) == want


def test_verification_and_route(spark):
    o = items(spark, [("1", "a", None, 1, "no"), ("2", "b", None, 9, "no"), ("3", "c", None, None, "no")]).withColumn("answer", F.expr("if(list_index = 0, 'yes', 'no')"))
    assert tuple(outline.verification(o, F.lit(10)).first())[1:] == (0.5, [1])
    assert tuple(outline.verification(o, F.lit(30)).first())[1:] == (0.0, [])
    routed = spark.createDataFrame([(1.0, 0), (0.7, 2), (0.6, 2), (0.0, 0)], "a double, n int").select(outline.route("a", "n").alias("r"))
    assert [r.r for r in routed.collect()] == ["accept", "fix", "fall_back", "fall_back"]


def test_write_back_and_preface(spark):
    o = items(spark, [("1", "a", None, 3, "no"), ("2", "b", None, 5, "no")])
    fixed = spark.createDataFrame([(1, 1, 6, True), (1, 0, 2, False), (1, 9, 2, True)], "doc_id long, list_index int, physical_index int, is_valid boolean")
    out, invalid = outline.write_back(o, fixed)
    assert sorted(r.physical_index for r in out.collect()) == [3, 6] and invalid.count() == 2
    assert [r.title for r in outline.with_preface(o).orderBy("list_index").collect()] == ["Preface", "a", "b"]


DET = "doc_id long, page_index int, det_index int, label string, x0 int, y0 int, x1 int, y1 int"


@pytest.mark.parametrize(("order", "want"), [((0, 1), {0: 2, 1: None}), ((1, 0), {1: 2, 0: None})])
def test_captions_go_to_the_first_content(spark, order, want):
    boxes = {0: ("figure", 0, 0, 100, 100), 1: ("table", 0, 150, 100, 250)}
    rows = [(1, 1, i, *boxes[b]) for i, b in enumerate(order)] + [(1, 1, 2, "table_caption", 0, 110, 100, 140)]
    got = {order[r.det_index]: r.caption_index for r in layout.captions(spark.createDataFrame(rows, DET)).collect()}
    assert got == want


def test_entities(spark):
    assert one(spark, "NaPF6 in diglyme, Ionic Conductivity 3.5 mS/cm", E.entities) == ["3.5 mS/cm", "NaPF6", "diglyme", "ionic conductivity"]
    assert one(spark, "napf6", E.entities) == [] and one(spark, None, E.entities) == []


@pytest.mark.parametrize(
    ("reply", "want"),
    [('```json\n{"a": None,}\n```', {"a": None}), ('{"t": "None of these"}', {"t": "null of these"}), ('{"a": 1, }', {}), ("Sure! [1, 2]", [1, 2]), ("  ", {}), ("<think>x</think>", {}), ("```json\n[1]", [1]), (None, {})],
)
def test_json_repair(spark, reply, want):
    assert json.loads(one(spark, reply, X.repair_json)) == want


def test_replies(spark):
    fmt = lambda c: one(spark, c, X.reply_format)
    assert fmt("") is None and fmt("plain") == "unknown" and fmt('<div data-label="x">') == "layout_html"
    body = one(spark, '<analyze>[{"titles":"T","legends":""}]</analyze>', X.figure_body)
    assert not body.truncated and one(spark, body.json, X.panels) == [{"title": '"T"'}]
    body = one(spark, '<ANALYZE>[{"titles":"T"},{"x_l', X.figure_body)
    assert body.truncated and one(spark, body.json, X.panels) == [{"title": '"T"'}]
    assert one(spark, "<analyze>[{", X.figure_body).json is None


def test_layout_blocks():
    found = X.layout_blocks('x<div data-bbox="1 2 3 4" data-label="T"><div>a &lt;b&gt;<br/></div></div>y<div data-label="U">open')
    assert found == [{"label": "T", "bbox": "1 2 3 4", "html": "<div>a <b><br/></div>"}]
    assert X.layout_blocks(None) == []


def test_layout_blocks_in_odd_markup():
    blocks = lambda s: [(b["label"], b["bbox"], b["html"]) for b in X.layout_blocks(s)]
    assert blocks("<DIV DATA-LABEL='a &amp; b'>x<!-- <div> -->y</DIV><div data-bbox=\"1\"><p class=c hidden>z</p></div>") == [("a & b", "", "xy"), (None, "1", '<p class="c">z</p>')]
    assert blocks('<div><div data-label="in">x</div></div>') == [("in", "", "x")]
    assert blocks('<div data-label="o"><div data-label="i">x</div>y</div></div>') == [("o", "", '<div data-label="i">x</div>y')]
    assert blocks('<div data-label="t" /><div data-label="u" title="a > b">x</div>') == [("u", "", "x")]
    assert blocks('1 < 2 <div data-label="v">3 < 4 &eacute;</div>') == [("v", "", "3 < 4 \u00e9")]


def test_envelopes_and_panels(spark):
    of = lambda c: one(spark, c, X.envelope)
    assert of("") is None and of(None) is None
    e = of("<analyze>[{\"titles")
    assert (e.format, e.truncated, e.panels, e.error) == ("figure_analysis", True, [], "unrecoverable")
    e = of("<analyze>{oops}</analyze>")
    assert (e.truncated, e.panels, e.error) == (False, [], "json")
    assert of("p" * 600).raw_head == "p" * 500 and of('<div data-label="x">').raw_head is None
    html = one(spark, '[{"titles":"<T>","x_labels":"a"},{"series":"s"}]', X.render_panels)
    assert html.splitlines() == ['<div class="analysis-block"><h4>&lt;T&gt;</h4><dl><dt>X Labels</dt><dd>a</dd></dl></div>', '<div class="analysis-block"><h4>Subplot 2</h4><dl><dt>Series</dt><dd>s</dd></dl></div>']
    assert one(spark, '<analyze>[]</analyze> [[{"series":"s","x":1}],{"y":3}]', X.trailing_points) == [{"series": "s", "x": "1"}, {"y": "3"}]
    assert one(spark, "<analyze>[]</analyze>", X.trailing_points) is None


def test_text_functions(spark):
    assert one(spark, "a ........ 5 . . . . . b", T.clean_dot_leaders) == "a :  5 : b"
    assert one(spark, " <think>\nx</think> y ", T.strip_thinking) == "y"
    assert one(spark, "pre ```json\n{}\n``` ``` post", T.fence_content) == "{}\n```"
    assert one(spark, " 1 2  3 4 ", T.parse_bbox) == [1, 2, 3, 4] and one(spark, "1 2 3", T.parse_bbox) is None
    assert one(spark, "a_p3_fig_1_olm_chart.md", lambda c: T.result_name_part(c, "img")) == "fig_1"
    assert one(spark, "a | b<0x0A>1 | 2", T.linear_rows) == [["a", "b"], ["1", "2"]] and one(spark, "a | b", T.linear_rows) is None
    assert one(spark, "x" * 2005, T.cap).endswith("[truncated, 5 more chars]")
    assert one(spark, None, T.asset_url) == "" and one(spark, "/r/kb/a/kb/b", T.asset_url) == "/kb/a/kb/b"
    assert one(spark, "plain", T.section_content) == "plain"
    assert one(spark, None, T.count_words) == 0 and one(spark, "a\tb  c", T.count_words) == 3
    assert one(spark, "a b", T.token_counter(list)) == 3


def test_retries_and_routing():
    class Flaky:
        def __init__(self, replies):
            self.replies, self.seen = list(replies), []

        def reply(self, prompt, inputs, temperature=0.0):
            self.seen.append(temperature)
            r = self.replies.pop(0)
            if isinstance(r, Exception):
                raise r
            return r

    waits = []
    p = Flaky([RuntimeError(), ("nope", "finished"), ('{"a":1}', "finished")])
    assert P.with_retries(p, "x", {}, True, wait=waits.append) == ('{"a":1}', "finished") and waits == [2.0]
    assert p.seen == pytest.approx([0.0, 0.2, 0.4])
    assert P.with_retries(Flaky([("cut", "length")]), "x", {}, True) == ("cut", "length")
    assert P.with_retries(Flaky([RuntimeError()] * 5), "x", {}) == ("", "error")
    assert P.schedule() == pytest.approx([0.0, 0.2, 0.4, 0.6, 0.6])
    assert P.choose("http://h:11434/v1") == "ollama" and P.choose("http://h/v1") == "openai"
    with pytest.raises(ValueError):
        P.choose("x", "other")
    shape = P.request_shape("anthropic", "m", [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}])
    assert shape["system"] == "s" and len(shape["messages"]) == 1
    prompts = P.Prompts()
    prompts.add("a", lambda x: f"A {x}", "long")
    prompts.add("b", lambda x: f"B {x}", "short")
    assert prompts.get("a", "short", x="1") == "A 1"
    with pytest.raises(ValueError):
        prompts.get("a", "none", x="1")
    with pytest.raises(KeyError):
        prompts.get("c", "short")


def test_rule_provider(spark):
    rule = P.RuleProvider()
    ask = lambda name, **i: json.loads(rule.reply(name, i)[0])
    assert ask("check_title_appearance_in_start", title="In  tro", page_text="intro In tro") == {"start_begin": "no"}
    assert ask("check_title_appearance", title="In  tro", page_text="x in\ntro") == {"answer": "yes"}
    part = "<physical_index_3>\nShort head\nbody\n<physical_index_3>\n\n"
    assert ask("generate_toc_init", part=part) == [{"structure": "1", "title": "Short head", "physical_index": "<physical_index_3>"}]
    assert ask("single_toc_item_index_fixer", section_title="short HEAD", content=part) == {"physical_index": "<physical_index_3>"}
    requests = spark.createDataFrame([("k", "generate_node_summary", {"node_text": "One. Two."})], "key string, prompt string, inputs map<string,string>")
    replies = P.ask(requests, rule)
    assert replies.first().text == "One." and P.unanswered(requests, replies).count() == 0


def test_bottom_up_and_subdivision(spark):
    o = items(spark, [("1", "a", None, 1, "no"), ("1.1", "b", None, 1, "no"), ("1.1.1", "c", None, 2, "no")])
    nodes = tree.build(outline.section_ranges(o, F.lit(3)))
    out = {r.node_id: r.summary for r in tree.bottom_up(nodes, "title", lambda t, b: F.concat(t, F.lit("("), b, F.lit(")"))).collect()}
    assert out == {"0002": "c", "0001": "b([0002] c\nc)", "0000": "a([0001] b\nb([0002] c\nc))"}
    big = spark.createDataFrame([(1, "0000", "Top", 1, 20), (1, "0001", "Small", 21, 22)], "doc_id long, node_id string, title string, start_index int, end_index int")

    def outline_of(large):
        rows = large.filter("title = 'Top'").select("doc_id", "code")
        made = spark.createDataFrame([(0, "Top ", 1, "yes"), (1, "One", 3, "no"), (2, "Two", 10, "yes")], "k int, title string, physical_index int, appear_start string")
        return rows.crossJoin(made)

    got = {r.code: (r.title, r.start_index, r.end_index) for r in tree.subdivide(big, outline_of, sized(spark, [2000] * 22)).collect()}
    assert got == {"0000": ("Top", 1, 3), "0001": ("Small", 21, 22), "0000.0001": ("One", 3, 9), "0000.0002": ("Two", 10, 20)}


def test_metrics_and_results(spark):
    calls = spark.createDataFrame([("m", 1.5, False, 10, None), ("m", 0.5, True, None, 3)], "model string, seconds double, error boolean, input_tokens long, output_tokens long")
    assert tuple(metrics.call_metrics(calls).first()) == ("m", 2, 2.0, 1.0, 1, 10, 3, 13)
    points = spark.createDataFrame([("k", 0, {"x": "1", "series": "s"}), ("k", 1, {"y": "2", "panel": "p"})], "key string, point_index int, point map<string,string>")
    tables = {r.series: (r.columns, r.rows) for r in results.series_tables(points).collect()}
    assert tables == {"s": (["x", "y"], [["1", ""]]), "data": (["x", "y"], [["", "2"]])}
    images = spark.createDataFrame([("a", "1", "f", "jpg", "j"), ("a", "1", "f", "png", "p")], "pdf_stem string, page string, img string, suffix string, path string")
    groups = results.grouped(results.with_keys(spark.createDataFrame([("a_p1_f_m_t.md",), ("b_p1_f_m_t.md",), ("odd.md",)], "name string")))
    assert [(r.pdf_stem, r.image) for r in results.with_images(groups, images).collect()] == [("a", "p")]
    path = spark.createDataFrame([("/d/paper/page_3/doclayout/figures/fig_1.png", "m", "t")], "path string, model string, task string")
    assert path.select(results.batch_name().alias("n")).first().n == "paper_p3_fig_1_m_t.md"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "in/b.txt").write_bytes(b"no")
    found = readers.page_files(spark, str(tmp_path / "in"), readers.text_pages).collect()
    assert [(r.doc_id, r.page_index, r.text) for r in found] == [("a", 1, "one"), ("a", 2, "two")]
    with pytest.raises(ValueError):
        readers.one_source(None, None)
    trees = spark.createDataFrame([(1, "[]"), (2, '[{"a":1}]')], "doc_id long, tree string")
    writers.write_trees(trees, str(tmp_path / "kb"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert writers.write_new(rows, str(tmp_path / "t"), ["k"]) == 2 and writers.write_new(rows, str(tmp_path / "t"), ["k"]) == 0
    (tmp_path / "base/p1").mkdir(parents=True)
    (tmp_path / "base/p1/tree.json").write_text("[]")
    assert [tuple(r) for r in readers.knowledge_base(spark, str(tmp_path / "base")).collect()] == [("p1", "[]")]
    with pytest.raises(PermissionError):
        readers.contained(str(tmp_path / "base"), "../in/a.pdf")
    with pytest.raises(FileNotFoundError):
        readers.contained(str(tmp_path / "base"), "none")
    (tmp_path / "gpu.ip").write_text("10.0.0.1\n")
    assert readers.resolve_url("instance://gpu:8000/v1", str(tmp_path)) == "http://10.0.0.1:8000/v1" and readers.resolve_url("http://x/v1", "") == "http://x/v1"
    shown = writers.comparison(spark.createDataFrame([("a", "1", "f", "n1", "m", "t", "x | y<0x0A>1 | 2"), ("a", "1", "f", "n2", "m", "t", "<b>")], "pdf_stem string, page string, img string, name string, model string, task string, text string"))
    assert "<th>x</th>" in shown.first().html and "&lt;b&gt;" in shown.first().html


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "NaPF6 a\nb"), (2, "c")], schema)
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.arriving(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, ingest.page_stream(docs).collect())) and len(got) == 3
