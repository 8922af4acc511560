"""The whole way from documents to summarised section trees, for any provider.

An outline comes from a contents list with page numbers, from one without, or from the text itself; a document whose
outline fails verification goes on to the next of the three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structured import outline_list
from ..functions.text import clean_dot_leaders, count_words, page_number, page_tag_number, strip
from ..operators import outline, pages, tree
from ..provider import Provider
from .steps import Run

KEYS = ["doc_id", "list_index"]
ITEMS = [*KEYS, "structure", "title", "page", "physical_index", "has_physical_index"]
FIX_ROUNDS = 3
CHECK_PAGES = 25


class Build(Run):
    """A run over documents, one row each with an array of all pages, in buckets by doc_id: texts are moved and written once."""

    def __init__(self, docs: DataFrame, provider: Provider, path: str, max_tokens: int = 10_000, separator: str = "\n"):
        super().__init__(docs.sparkSession, provider, path)
        self.max_tokens = max_tokens
        paged = docs.filter("text is not null").select("doc_id", F.split("text", separator).alias("pages"))
        self.docs = self.dealt(paged.withColumn("tokens", F.transform("pages", count_words)), "documents")
        self.n_pages = self.written(self.docs.select("doc_id", F.size("pages").alias("n_")), "n_pages")

    def beside(self, rows: DataFrame) -> DataFrame:
        """rows with the pages and their tokens of their documents; only rows are moved, whatever their number."""
        return self.docs.join(rows.hint("shuffle_hash"), "doc_id")

    # --- contents lists

    def contents(self) -> DataFrame:
        """doc_id, toc, has_numbers, last_ (position of its last page) of the documents that have a contents list."""
        sized, answers = self.docs.withColumn("n_", F.size("pages")).withColumns({"limit_": pages.contents_cap("n_", CHECK_PAGES), "done_": F.lit(0)}), None
        while True:
            frontier = sized.select("doc_id", "n_", "limit_", "done_", F.posexplode(F.slice("pages", F.col("done_") + 1, F.col("limit_"))).alias("at_", "text"))
            frontier = frontier.withColumn("page_index", F.col("done_") + F.col("at_") + 1)
            told = self.asked(frontier, "toc_detector_single_page", {"content": "text"}, ["doc_id", "page_index", "n_", "limit_"])
            told = told.select("doc_id", "page_index", "n_", "limit_", F.coalesce(F.get_json_object("json", "$.toc_detected"), F.lit("no")).alias("answer"))
            answers = self.written(told if answers is None else answers.unionByName(told), "contents_pages")
            # a run that is open at the last page looked at goes on
            last = answers.groupBy("doc_id").agg(F.max("page_index").alias("done_"), F.max("n_").alias("n_"), F.max("limit_").alias("limit_"), F.max_by("answer", "page_index").alias("last_answer"))
            open_ = self.written(last.filter("last_answer = 'yes' and done_ < n_").drop("last_answer"), "more_pages")
            if open_.isEmpty():
                break
            sized = self.beside(open_)
        runs = self.written(pages.contents_runs(answers, "answer", F.col("limit_")), "runs")
        places = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list("position")).alias("at_"), F.max("position").alias("last_"))
        whole = F.array_join(F.transform("at_", lambda i: F.get("pages", i)), "")
        lists = self.written(self.beside(places).select("doc_id", "run", clean_dot_leaders(whole).alias("toc"), "last_"), "contents_lists")
        numbered = self.asked(lists, "detect_page_index", {"toc_content": "toc"}, ["doc_id", "run"]).select("doc_id", "run", (F.get_json_object("json", "$.page_index_given_in_toc") == "yes").alias("has_numbers"))
        numbered = self.written(numbered, "numbered")
        return self.written(lists.join(pages.pick_run(runs, numbered), ["doc_id", "run"]).join(numbered, ["doc_id", "run"]).drop("run"), "contents")

    def parts(self, docs: DataFrame) -> DataFrame:
        """The columns of docs (doc_id, once each, and more) with chunk and text; not written."""
        packed = self.beside(docs).select(*docs.columns, "pages", F.posexplode(pages.pack(F.col("tokens"), self.max_tokens)).alias("chunk", "c"))
        return packed.filter("c.last > c.first").select(*docs.columns, "chunk", pages.tagged("pages", F.col("c.first") + 1, F.col("c.last")).alias("text"))

    def tagged(self, spans: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
        """keys and content: the tagged pages from first to last of every row of spans."""
        wanted = spans.select(*keys, F.greatest(F.col(first), F.lit(1)).alias("from_"), F.col(last).alias("to_")).filter("to_ >= from_")
        return self.beside(wanted).filter("from_ <= size(pages)").select(*keys, pages.tagged("pages", F.col("from_"), F.col("to_")).alias("content"))

    # --- outlines, one function for each way

    def _items(self, rows: DataFrame, *order: str) -> DataFrame:
        """Items of the outlines in `json`, numbered by document."""
        listed = rows.select("doc_id", *order, F.posexplode(F.from_json(outline_list("json"), "array<map<string,string>>")).alias("k", "i"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "k")) - 1
        i = lambda name: F.col("i")[name]
        return listed.select("doc_id", place.alias("list_index"), i("structure").alias("structure"), i("title").alias("title"), page_number(i("page")).alias("page"), page_tag_number(i("physical_index")).alias("physical_index"), F.map_contains_key("i", "physical_index").alias("has_physical_index"))

    def _as_json(self, items: DataFrame) -> DataFrame:
        """doc_id, outline: the items as a JSON list, without page numbers."""
        item = F.struct("structure", "title", F.when(F.col("physical_index").isNotNull(), F.format_string("<physical_index_%d>", "physical_index")).alias("physical_index"))
        return items.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("list_index", item.alias("x")))), lambda s: s["x"])).alias("outline"))

    def transformed(self, lists: DataFrame) -> DataFrame:
        return self.written(self._items(self.asked(lists, "toc_transformer", {"toc_content": "toc"}, ["doc_id"])), "transformed")

    def with_page_numbers(self, lists: DataFrame) -> DataFrame:
        """Printed page numbers moved by the offset that the titles found in the text show; the rest asked for between known neighbours."""
        items = self.transformed(lists)
        spans = lists.select("doc_id", (F.col("last_") + 2).alias("first_"), (F.col("last_") + 1 + CHECK_PAGES).alias("end_")).join(self._as_json(items), "doc_id", "left").fillna({"outline": "[]"})
        found = self.tagged(spans, ["doc_id", "outline"], "first_", "end_")
        indexed = self.written(self._items(self.asked(found, "toc_index_extractor", {"toc": "outline", "content": "content"}, ["doc_id"])), "indexed")
        starts = lists.select("doc_id", (F.col("last_") + 1).alias("start_"))
        pairs = outline.match_titles(items, indexed.join(starts, "doc_id").filter("physical_index >= start_"), 0)
        moved = self.written(outline.apply_offset(items, outline.page_offset(pairs)), "moved")
        open_ = self.written(outline.missing_items(moved), "open")
        if open_.isEmpty():
            return moved
        texts = self.tagged(open_, [*KEYS, "structure", "title"], "previous", "following")
        told = self.asked(texts, "add_page_number_to_toc", {"part": "content", "structure": F.to_json(F.struct("structure", "title"))}, KEYS)
        first = page_tag_number(F.get_json_object(outline_list("json"), "$[0].physical_index"))
        fixed = told.select(*KEYS, first.alias("physical_index"), first.isNotNull().alias("is_valid"))
        return self.written(outline.write_back(moved, fixed)[0], "completed")

    def without_page_numbers(self, lists: DataFrame) -> DataFrame:
        """Pages of the contents' titles, asked for chunk by chunk; a chunk's reply is the next one's outline."""
        items, parts = self.transformed(lists), self.dealt(self.parts(lists.select("doc_id")), "parts", lies=True)
        for k in range((parts.agg(F.max("chunk")).first()[0] or -1) + 1):
            rows = parts.filter(F.col("chunk") == k).join(self._as_json(items).hint("shuffle_hash"), "doc_id", "left").fillna({"outline": "[]"})
            told = self._items(self.asked(rows, "add_page_number_to_toc", {"part": "text", "structure": "outline"}, ["doc_id"]))
            items = self.written(told.unionByName(items.join(rows.select("doc_id"), "doc_id", "left_anti")), "numbered")
        return items

    def from_text(self, docs: DataFrame, lists: DataFrame) -> DataFrame:
        """Sections found in the text chunk by chunk, with what was found before, and a contents list as a hint at first."""
        docs, hints, keys = docs.select("doc_id"), lists.select("doc_id", "toc"), ["doc_id", "chunk"]
        told = self.asked(self.parts(docs.join(hints, "doc_id", "left_anti")).filter("chunk = 0"), "generate_toc_init", {"part": "text"}, keys)
        told = told.unionByName(self.asked(self.parts(docs.join(hints, "doc_id")).filter("chunk = 0"), "generate_toc_init_with_hint", {"part": "text", "toc_hint": "toc"}, keys))
        made = self.written(self._items(told, "chunk"), "made")
        later = self.dealt(self.parts(docs).filter("chunk > 0"), "later", lies=True)
        for k in range(1, (later.agg(F.max("chunk")).first()[0] or 0) + 1):
            rows = later.filter(F.col("chunk") == k).join(self._as_json(made).hint("shuffle_hash"), "doc_id", "left")
            more = self._items(self.asked(rows, "generate_toc_continue", {"part": "text", "toc_content": F.coalesce("outline", F.lit("[]"))}, keys), "chunk")
            have = made.groupBy("doc_id").agg((F.max("list_index") + 1).alias("have_"))
            more = more.join(have, "doc_id", "left").withColumn("list_index", F.col("list_index") + F.coalesce("have_", F.lit(0))).drop("have_")
            made = self.written(made.unionByName(more), "made")
        return made

    # --- verification

    def checked(self, items: DataFrame) -> DataFrame:
        """Items with answer (title is on its page) and appear_start (title opens it); `no` without a page."""
        on = self.beside(items.select(*KEYS, "title", "physical_index")).filter("physical_index between 1 and size(pages)")
        known = self.written(on.select(*KEYS, "title", F.get("pages", F.col("physical_index") - 1).alias("page_text")), "known")
        inputs = {"title": "title", "page_text": "page_text"}
        there = self.asked(known, "check_title_appearance", inputs, KEYS).select(*KEYS, F.get_json_object("json", "$.answer").alias("answer"))
        opens = self.asked(known, "check_title_appearance_in_start", inputs, KEYS).select(*KEYS, F.get_json_object("json", "$.start_begin").alias("appear_start"))
        return self.written(items.join(there, KEYS, "left").join(opens, KEYS, "left").fillna({"answer": "no", "appear_start": "no"}), "checked")

    def fixed(self, items: DataFrame) -> DataFrame:
        """Items with the indices that failed asked for again between their correct neighbours, and checked there, up to FIX_ROUNDS times."""
        for _ in range(FIX_ROUNDS):
            around = outline.correct_anchors(items.join(self.n_pages, "doc_id"), F.col("answer") != "yes", "n_")
            failing = self.written(around.filter("answer <> 'yes'"), "failing")
            if failing.isEmpty():
                break
            content = self.tagged(failing, [*KEYS, "title"], "previous", "following")
            told = self.asked(content, "single_toc_item_index_fixer", {"section_title": "title", "content": "content"}, [*KEYS, "title"])
            moved = self.written(told.select(*KEYS, "title", page_tag_number(F.get_json_object("json", "$.physical_index")).alias("physical_index")).filter("physical_index is not null"), "moved")
            again = self.checked(moved).select(*KEYS, "physical_index", F.col("answer").alias("new_"), F.col("appear_start").alias("opens_"))
            good = again.filter("new_ = 'yes'").withColumn("is_valid", F.lit(True))
            items = outline.write_back(items, good.drop("new_", "opens_"))[0].join(good.select(*KEYS, "new_", "opens_"), KEYS, "left")
            items = self.written(items.withColumns({"answer": F.coalesce("new_", "answer"), "appear_start": F.coalesce("opens_", "appear_start")}).drop("new_", "opens_"), "fixed")
        return items

    def verified(self, items: DataFrame, last: bool) -> DataFrame:
        """The checked items of the documents whose outline is accepted, or fixed; the last way's are kept as they are."""
        known = outline.located(outline.drop_beyond(items.select(*ITEMS).join(self.n_pages, "doc_id"), "n_")).drop("n_")
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("list_index")) - 1
        checked = self.checked(self.written(known.withColumn("list_index", place), "located"))
        verdict = outline.verification(checked.join(self.n_pages, "doc_id"), "n_").select("doc_id", outline.route("accuracy", F.size("failures")).alias("next_"))
        routed = self.written(checked.join(verdict, "doc_id"), "routed")
        mended = self.fixed(routed.filter("next_ = 'fix'").drop("next_"))
        return self.written(mended.unionByName(routed.filter("next_ = 'accept'" if not last else "next_ <> 'fix'").drop("next_")), "verified")

    def outlines(self) -> DataFrame:
        """Verified items of all documents that have any."""
        lists = self.contents()
        done, left = None, self.n_pages.select("doc_id")
        ways = [(self.with_page_numbers, lists.filter("has_numbers")), (self.without_page_numbers, lists), (lambda d: self.from_text(d, lists), self.n_pages)]
        for i, (way, fit) in enumerate(ways):
            some = self.written(fit.join(left, "doc_id", "left_semi"), "some")
            if some.isEmpty():
                continue
            good = self.verified(way(some), i == len(ways) - 1)
            done = good if done is None else done.unionByName(good)
            left = self.written(left.join(good, "doc_id", "left_anti"), "left")
        return done


def build(docs: DataFrame, provider: Provider, path: str, max_tokens: int = 10_000, overlap: int = 1, separator: str = "\n") -> DataFrame:
    """Nodes with summaries: doc_id, node_id, parent_index, list_index, depth, title, start_index, end_index, summary.

    A document without an outline becomes one node, `Document`. docs: doc_id, once each, and text; null and empty texts have no nodes.
    """
    docs = docs.select("doc_id", "text").filter(F.length(strip("text")) > 0)
    run = Build(docs, provider, path, max_tokens, separator)
    located = run.outlines()
    if located is None:
        return run.spark.createDataFrame([], "doc_id long, node_id string, parent_index int, list_index int, depth int, title string, start_index int, end_index int, summary string")
    located = run.written(outline.with_preface(located), "prefaced")
    alone = run.n_pages.join(located.select("doc_id").distinct(), "doc_id", "left_anti")
    values = {"list_index": F.lit(0), "structure": F.lit("1"), "title": F.lit("Document"), "physical_index": F.lit(1), "has_physical_index": F.lit(True)}
    whole = alone.select(*(F.col("doc_id") if c == "doc_id" else values.get(c, F.lit(None)).cast(located.schema[c].dataType).alias(c) for c in located.columns))
    ranged = outline.section_ranges(located.unionByName(whole).join(run.n_pages, "doc_id"), "n_").drop("n_")
    nodes = run.written(tree.build(ranged), "nodes")
    texts = tree.paged_texts(nodes, run.docs, overlap)
    summaries = run.asked(texts, "generate_node_summary", {"node_text": "text"}, ["doc_id", "node_id"], json_mode=False).select("doc_id", "node_id", F.col("reply").alias("summary"))
    return nodes.join(summaries, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "parent_index", "list_index", "depth", "title", "start_index", "end_index", "summary")
