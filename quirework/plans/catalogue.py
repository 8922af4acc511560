"""Queries over the test tables, one or more for each operator, with their DuckDB SQL where SQL can say it.

The tables hold no scanned papers, so they stand in: a line of a document is a page, short lines are outline items, boxes
come from order lines, model calls from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import structured as X
from ..functions import text as T
from ..operators import layout, metrics, outline, pages, results, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- stand-ins, in both languages

WORDS = r"[^\x20\x09-\x0D]+"
SQL_PAGES = f"""
docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pages_ AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS page_index, unnest(l) AS text FROM docs),
pg AS (SELECT doc_id, page_index, text, len(regexp_extract_all(text, '{WORDS}'))::INT AS tokens FROM pages_),
np AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1)"""
SQL_OUTLINE = (
    SQL_PAGES
    + """,
o1 AS (SELECT doc_id, page_index, tokens, text AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1)::INT AS list_index
       FROM pg WHERE tokens BETWEEN 1 AND 9),
ol AS (SELECT doc_id, list_index, CASE WHEN list_index % 4 = 0 THEN (list_index // 4 + 1)::VARCHAR
              WHEN list_index % 4 = 3 THEN (list_index // 4 + 1)::VARCHAR || '.2.' || (list_index % 4)::VARCHAR
              ELSE (list_index // 4 + 1)::VARCHAR || '.' || (list_index % 4)::VARCHAR END AS structure,
              title, (page_index + 2 + CASE WHEN tokens % 3 = 0 THEN 1 ELSE 0 END)::INT AS page,
              CASE WHEN tokens % 5 <> 4 THEN page_index END AS physical_index, tokens % 5 <> 3 AS has_physical_index,
              CASE WHEN tokens % 2 = 0 THEN 'yes' ELSE 'no' END AS appear_start, CASE WHEN tokens % 3 = 1 THEN 'no' ELSE 'yes' END AS answer FROM o1)"""
)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.pages_of(_read(spark, sf, "documents"))


def _paged(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("pages"))


def _outline(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    short = _pages(spark, sf).filter("tokens between 1 and 9")
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1
    rows = short.withColumn("list_index", i)
    return rows.selectExpr(
        "doc_id", "list_index",
        "case when list_index % 4 = 0 then cast(list_index div 4 + 1 as string) when list_index % 4 = 3 then concat(list_index div 4 + 1, '.2.', list_index % 4) else concat(list_index div 4 + 1, '.', list_index % 4) end as structure",
        "text as title", "page_index + 2 + if(tokens % 3 = 0, 1, 0) as page", "if(tokens % 5 <> 4, page_index, null) as physical_index",
        "tokens % 5 <> 3 as has_physical_index", "if(tokens % 2 = 0, 'yes', 'no') as appear_start", "if(tokens % 3 = 1, 'no', 'yes') as answer",
    )


def _n_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.totals(_pages(spark, sf)).select("doc_id", F.col("n_pages").cast("int").alias("n"))


def _ranged(spark: SparkSession, sf: str) -> DataFrame:
    items = outline.located(_outline(spark, sf)).join(_n_pages(spark, sf), "doc_id")
    return outline.section_ranges(items, "n").drop("n", "answer")


SQL_RANGES = (
    SQL_OUTLINE
    + """,
rg AS (SELECT ol.*, physical_index AS start_index,
         CASE WHEN lead(list_index) OVER w IS NULL THEN np.n::INT WHEN lead(appear_start) OVER w = 'yes' THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END AS end_index
       FROM ol JOIN np USING (doc_id) WHERE physical_index IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY list_index))"""
)
SQL_PARENTS = (
    SQL_RANGES
    + r""",
up AS (SELECT *, nullif(CASE WHEN contains(structure, '.') THEN regexp_replace(structure, '\.[^.]*$', '') END, '') AS u FROM rg),
pt AS (SELECT c.*, (SELECT max(p.list_index) FROM rg p WHERE p.doc_id = c.doc_id AND p.structure = c.u AND p.list_index < c.list_index) AS parent_index FROM up c)"""
)
SQL_NODES = (
    SQL_PARENTS.replace("docs AS", "RECURSIVE docs AS", 1)
    + """,
walk AS (SELECT doc_id, list_index, parent_index, lpad(list_index::VARCHAR, 6, '0') AS path, 0 AS depth FROM pt WHERE parent_index IS NULL
         UNION ALL SELECT c.doc_id, c.list_index, c.parent_index, w.path || '.' || lpad(c.list_index::VARCHAR, 6, '0'), w.depth + 1 FROM pt c JOIN walk w ON c.doc_id = w.doc_id AND c.parent_index = w.list_index),
nd AS (SELECT pt.*, walk.depth, (row_number() OVER (PARTITION BY pt.doc_id ORDER BY path) - 1)::INT AS preorder FROM pt JOIN walk USING (doc_id, list_index)),
nodes_ AS (SELECT *, format('{:04d}', preorder) AS node_id FROM nd)"""
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _on_docs(**cols: str) -> str:
    return "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM documents"


# --- pages


@query(f"WITH {SQL_PAGES} SELECT doc_id, page_index, tokens FROM pg")
def page_tokens(spark, sf):
    return _pages(spark, sf).select("doc_id", "page_index", "tokens")


@query(f"WITH {SQL_PAGES} SELECT doc_id, count(*) AS n_pages, sum(tokens)::BIGINT AS n_tokens FROM pg GROUP BY 1")
def doc_token_totals(spark, sf):
    return pages.totals(_pages(spark, sf))


@query(f"WITH {SQL_PAGES}, r AS (SELECT doc_id, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY tokens) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM pg) SELECT doc_id, tokens AS median_words, tokens < 30 AS scanned FROM r WHERE i = n // 2")
def scanned_docs(spark, sf):
    return pages.likely_scanned(_pages(spark, sf))


@query(f"WITH {SQL_PAGES} SELECT doc_id, least(25, greatest(3, n // 3))::INT AS pages_checked FROM np")
def contents_caps(spark, sf):
    return _n_pages(spark, sf).select("doc_id", pages.contents_cap("n").alias("pages_checked"))


_ANSWER = "CASE WHEN tokens % 7 = 0 THEN 'maybe' WHEN tokens % 3 = 0 THEN 'no' ELSE 'yes' END"


@query(f"""WITH {SQL_PAGES}, a AS (SELECT doc_id, page_index - 1 AS position, {_ANSWER} AS answer, least(25, greatest(3, n // 3)) AS lim FROM pg JOIN np USING (doc_id)),
f AS (SELECT doc_id, min(position) AS first FROM a WHERE answer = 'yes' AND position < lim GROUP BY 1),
e AS (SELECT a.doc_id, min(position) AS last FROM a JOIN f USING (doc_id) WHERE answer = 'no' AND position > first GROUP BY 1)
SELECT a.doc_id, a.position FROM a JOIN f USING (doc_id) LEFT JOIN e USING (doc_id) WHERE answer = 'yes' AND position >= first AND (last IS NULL OR position < last)""")
def toc_run(spark, sf):
    answered = _pages(spark, sf).join(_n_pages(spark, sf), "doc_id").withColumn("answer", F.expr(_ANSWER))
    return pages.contents_run(answered, "answer", pages.contents_cap("n"))


@query(f"""WITH {SQL_PAGES}, a AS (SELECT doc_id, page_index - 1 AS position, {_ANSWER} AS answer FROM pg),
i AS (SELECT *, sum(CASE WHEN answer = 'no' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS k FROM a),
y AS (SELECT *, min(position) OVER (PARTITION BY doc_id, k) AS first FROM i WHERE answer = 'yes')
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY first)::INT AS run, position FROM y WHERE first < 25""")
def toc_runs(spark, sf):
    return pages.contents_runs(_pages(spark, sf).withColumn("answer", F.expr(_ANSWER)), "answer", F.lit(25))


@query(f"""WITH {SQL_PAGES}, a AS (SELECT doc_id, page_index - 1 AS position, {_ANSWER} AS answer, tokens FROM pg),
i AS (SELECT *, sum(CASE WHEN answer = 'no' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS k FROM a),
y AS (SELECT *, min(position) OVER (PARTITION BY doc_id, k) AS first FROM i WHERE answer = 'yes'),
r AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY first)::INT AS run, position, tokens FROM y WHERE first < 25),
h AS (SELECT doc_id, run, bool_or(tokens % 5 = 0) AS has FROM r GROUP BY 1, 2)
SELECT doc_id, coalesce(min(CASE WHEN has THEN run END), min(run)) AS run FROM h GROUP BY 1""")
def toc_pick(spark, sf):
    p = _pages(spark, sf).withColumn("answer", F.expr(_ANSWER))
    runs = pages.contents_runs(p, "answer", F.lit(25))
    numbers = runs.join(p.select("doc_id", (F.col("page_index") - 1).alias("position"), "tokens"), ["doc_id", "position"]).groupBy("doc_id", "run").agg(F.bool_or(F.col("tokens") % 5 == 0).alias("has_numbers"))
    return pages.pick_run(runs, numbers)


@query(f"""WITH RECURSIVE {SQL_PAGES.strip()}, g AS (SELECT doc_id, list(tokens ORDER BY page_index) AS t, sum(tokens) AS total FROM pg GROUP BY 1),
b AS (SELECT *, ceil((total / ceil(total / 120.0) + 120) / 2.0) AS target FROM g),
s AS (SELECT doc_id, 0 AS i, 0 AS first, 0::BIGINT AS n, 0 AS chunk, CAST(NULL AS INT) AS out_first, CAST(NULL AS INT) AS out_last FROM b WHERE total > 120
  UNION ALL
  SELECT s.doc_id, i + 1, CASE WHEN over_ THEN greatest(i - 1, 0) ELSE first END, CASE WHEN over_ THEN coalesce(t[i], 0) ELSE s.n END + t[i + 1], CASE WHEN over_ THEN chunk + 1 ELSE chunk END,
         CASE WHEN over_ THEN first END, CASE WHEN over_ THEN i END
  FROM (SELECT s.*, b.t, s.n + b.t[s.i + 1] > b.target AS over_ FROM s JOIN b USING (doc_id) WHERE s.i < len(b.t)) s),
c AS (SELECT doc_id, chunk - 1 AS chunk, out_first AS f, out_last AS l FROM s WHERE out_last IS NOT NULL
  UNION ALL SELECT s.doc_id, chunk, first, i FROM s JOIN b USING (doc_id) WHERE s.i = len(b.t)
  UNION ALL SELECT doc_id, 0, 0, len(t) FROM b WHERE total <= 120)
SELECT c.doc_id, chunk::INT AS chunk, (f + 1)::INT AS first_page, l::INT AS last_page, coalesce(list_sum(t[f + 1 : l]), 0)::BIGINT AS n_tokens FROM c JOIN b USING (doc_id)""")
def page_chunks(spark, sf):
    return pages.chunks(_pages(spark, sf), most=120)


@query(f"WITH {SQL_PAGES} SELECT doc_id, page_index, '<physical_index_' || page_index || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_index || '>' || chr(10) || chr(10) AS tagged FROM pg")
def page_tags(spark, sf):
    return _pages(spark, sf).select("doc_id", "page_index", T.wrap_page("page_index", "text").alias("tagged"))


@query(f"WITH {SQL_PAGES}, s AS (SELECT DISTINCT doc_id, (doc_id % 13)::INT AS page_index FROM documents) SELECT s.doc_id, s.page_index, pg.doc_id IS NOT NULL AS found FROM s LEFT JOIN pg USING (doc_id, page_index)")
def page_selection(spark, sf):
    choice = _read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 13).cast("int").alias("page_index")).distinct()
    there, missing = pages.selected(choice, _pages(spark, sf))
    return there.select("doc_id", "page_index", F.lit(True).alias("found")).unionByName(missing.select("doc_id", "page_index", F.lit(False).alias("found")))


# --- scalar functions


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::INT WHEN doc_id % 3 = 1 THEN doc_id::INT END AS number, CASE WHEN doc_id % 3 = 2 THEN 'page ' || doc_id ELSE doc_id::VARCHAR END AS label, CASE WHEN doc_id % 3 <> 2 THEN doc_id::INT END AS page FROM documents")
def physical_index_parse(spark, sf):
    tag = F.expr("case doc_id % 3 when 0 then concat('<physical_index_', doc_id, '>') when 1 then concat('physical_index_', doc_id) else concat('page ', doc_id) end")
    return _read(spark, sf, "documents").select("doc_id", T.page_tag_number(tag).alias("number"), T.page_tag_or_text(tag).alias("label"), T.page_number(F.expr("if(doc_id % 3 = 2, concat('p', doc_id), concat(' ', doc_id))")).alias("page"))


@query(_on_docs(cleaned=r"regexp_replace(regexp_replace(text || '.......' || doc_id || ' x. . . . . .', '[.]{5,}', ': ', 'g'), '([.] ){5,}[.]?', ': ', 'g')"))
def dot_leader_clean(spark, sf):
    c = F.expr("concat(text, '.......', doc_id, ' x. . . . . .')")
    return _read(spark, sf, "documents").select("doc_id", T.clean_dot_leaders(c).alias("cleaned"))


@query(_on_docs(kept="trim(replace(lang || source, chr(10), ' '))"))
def strip_thinking(spark, sf):
    c = F.expr("concat(' <think>', text, '\n</think>', lang, source, '<think></think> ')")
    return _read(spark, sf, "documents").select("doc_id", T.strip_thinking(c).alias("kept"))


@query("""SELECT doc_id, '{"id": ' || doc_id || '}' AS body, TRUE AS valid FROM documents""")
def fence_content(spark, sf):
    c = F.expr("concat('Sure:\n```json\n{\"id\": ', doc_id, '}\n```\nDone.')")
    return _read(spark, sf, "documents").select("doc_id", T.fence_content(c).alias("body"), X.is_json(T.fence_content(c)).alias("valid"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a": null, "n": ' || doc_id || '}' WHEN 1 THEN '[1, ' || doc_id || ']' WHEN 2 THEN '{}' ELSE '{"n":' || doc_id || '}' END AS repaired FROM documents""")
def json_repair(spark, sf):
    c = F.expr("""case doc_id % 4 when 0 then concat('```json\n{"a": None,\n "n": ', doc_id, '}\n```') when 1 then concat('Sure! [1, ', doc_id, ']') when 2 then '{"a": 1, }' else concat('<think>x</think>{"n":', doc_id, ',}') end""")
    return _read(spark, sf, "documents").select("doc_id", X.repair_json(c).alias("repaired"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN '[{"title":"' || lang || '"}]' END AS items FROM documents""")
def outline_shapes(spark, sf):
    item = """'[{"title":"', lang, '"}]'"""
    c = F.expr(f"""case doc_id % 5 when 0 then concat({item}) when 1 then concat('{{"toc":', {item}, ',"x":1}}') when 2 then concat('{{"contents":1,"table_of_contents":', {item}, '}}') when 3 then concat('{{"odd":', {item}, '}}') else '{{"a":[1],"b":[2]}}' end""")
    return _read(spark, sf, "documents").select("doc_id", X.outline_list(c).alias("items"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[{chr(92)}x20{chr(92)}x09-{chr(92)}x0D]+', ' ', 'g')) AS plain FROM pages")
def tag_strip(spark, sf):
    return _read(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("plain"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [doc_id::INT, (doc_id + 1)::INT, 30, 40] END AS bbox FROM documents")
def bbox_parse(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.parse_bbox(F.expr("if(doc_id % 2 = 0, concat(' ', doc_id, ' ', doc_id + 1, ' 30  40'), concat(doc_id, ' -1 3 4'))")).alias("bbox"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<TABLE border=1><tr><td>' || page_id || '</td></tr></table>' END AS first FROM pages")
def first_table(spark, sf):
    c = F.expr("if(page_id % 2 = 0, concat(html, '<TABLE border=1><tr><td>', page_id, '</td></tr></table><table></table>'), html)")
    return _read(spark, sf, "pages").select("page_id", T.first_table(c).alias("first"))


@query("""SELECT doc_id, '<a href="' || source || '">' AS tag, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE source END AS joined FROM documents""")
def rendered_tags(spark, sf):
    tag = T.render_tag(F.lit("a"), F.create_map(F.lit("href"), F.col("source"), F.lit("id"), F.lit(None).cast("string")))
    return _read(spark, sf, "documents").select("doc_id", tag.alias("tag"), T.join_texts(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), "source").alias("joined"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE trim(lang || doc_id) END AS section FROM documents")
def section_slice(spark, sf):
    c = F.expr("case doc_id % 3 when 0 then source when 1 then concat('pre<<<section-content>>>\n', lang, doc_id, '\n<<<context-after>>>post') else concat('<<<section-content>>>', lang, doc_id) end")
    return _read(spark, sf, "documents").select("doc_id", T.section_content(c).alias("section"))


@query(r"""SELECT doc_id, '[fig_' || doc_id || '] type=figure, page=' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  caption: ' || lang ELSE '' END || chr(10) || '  chem_entities: a, ' || source AS element,
'[' || doc_id || '] ' || lang || chr(10) || CASE WHEN doc_id % 2 = 0 THEN source ELSE '(no summary)' END AS child FROM documents""")
def element_blocks(spark, sf):
    even = F.col("doc_id") % 2 == 0
    element = T.element_block(F.expr("concat('fig_', doc_id)"), F.lit("figure"), F.col("doc_id") % 9, F.when(even, F.col("lang")), F.lit(""), F.array(F.lit("a"), F.col("source")))
    return _read(spark, sf, "documents").select("doc_id", element.alias("element"), T.child_block(F.col("doc_id").cast("string"), "lang", F.when(even, F.col("source")).otherwise("")).alias("child"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url || '''<\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime, CASE WHEN page_id % 2 = 0 THEN '/kb/p' || page_id || '/a.png' ELSE '/x/' || page_id END AS asset FROM pages")
def html_escape(spark, sf):
    return _read(spark, sf, "pages").select("page_id", T.escape_html(F.concat("url", F.lit("'<\">"))).alias("escaped"), T.image_type(F.expr("if(page_id % 2 = 0, 'a/b.c.jpg', 'a.PNG')")).alias("mime"), T.asset_url(F.expr("if(page_id % 2 = 0, concat('/root/kb/p', page_id, '/a.png'), concat('/x/', page_id))")).alias("asset"))


@query("""SELECT page_id, '<p><aside class="img-desc">' || page_id || '</aside></p><img src="a.png">' AS html_, CASE WHEN length(html) > 2000 THEN substr(html, 1, 2000) || chr(10) || '…[truncated, ' || (length(html) - 2000) || ' more chars]' ELSE html END AS capped FROM pages""")
def dead_images(spark, sf):
    c = F.expr("""concat('<p><img class="x" alt="', page_id, '"><img alt=""></p><img src="a.png">')""")
    return _read(spark, sf, "pages").select("page_id", T.drop_dead_images(c).alias("html_"), T.cap("html").alias("capped"))


@query("SELECT doc_id, ['x^' || doc_id, 'y_' || lang] AS spans, replace(lang || ' ' || source, ' ', '_') AS slug, CASE WHEN doc_id % 3 = 0 THEN 'finished' ELSE 'max_output_reached' END AS reason FROM documents")
def math_spans(spark, sf):
    c = F.expr("concat('a $$x^', doc_id, '$$ b $y_', lang, '$ c')")
    return _read(spark, sf, "documents").select("doc_id", T.math_spans(c).alias("spans"), T.slug(F.concat_ws(" ", "lang", "source")).alias("slug"), T.finish_reason(F.expr("element_at(array('stop', 'max_tokens', 'length'), cast(doc_id % 3 as int) + 1)")).alias("reason"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [['a', lang], [doc_id::VARCHAR, source]] END AS cells FROM documents")
def linear_table(spark, sf):
    c = F.expr("if(doc_id % 2 = 0, concat('a | ', lang, ' <0x0A>', doc_id, ' | ', source), 'one | row')")
    return _read(spark, sf, "documents").select("doc_id", T.linear_rows(c).alias("cells"))


# --- entities

_CHEM = "concat(text, ' NaPF6 in diglyme, Ionic Conductivity ', doc_id, '.5 mS/cm and Na3Zr2Si2PO12 with P2-type Na0.67MnO2 .')"
_SQL_CHEM = "text || ' NaPF6 in diglyme, Ionic Conductivity ' || doc_id || '.5 mS/cm and Na3Zr2Si2PO12 with P2-type Na0.67MnO2 .'"
_SQL_SEEDS = "[" + ", ".join("'" + s + "'" for s in E.SEEDS) + "]"


@query(f"SELECT doc_id, list_filter({_SQL_SEEDS}, lambda s: contains(t, s) OR (NOT regexp_matches(s, '^[A-Z]') AND contains(lower(t), lower(s)))) AS seeds FROM (SELECT doc_id, {_SQL_CHEM} AS t FROM documents)")
def seed_entities(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", E.seeds_in(F.expr(_CHEM)).alias("seeds"))


# words and their ends are those of all languages; DuckDB's regexes know ASCII's only, so the rest has no SQL


def _chem(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", F.expr(f"coalesce({_CHEM}, '')").alias("t"))


@query()
def formula_entities(spark, sf):
    return _chem(spark, sf).select("doc_id", *(E.pattern_hits("t", p).alias(n) for n, p in (("formulas", E.FORMULA), ("salts", E.SODIUM_SALT), ("electrolytes", E.SOLID_ELECTROLYTE), ("oxides", E.LAYERED_OXIDE), ("measures", E.MEASURE))))


@query()
def document_entities(spark, sf):
    return _chem(spark, sf).select("doc_id", E.entities("t").alias("found"))


@query()
def entity_doc_counts(spark, sf):
    return document_entities(spark, sf).select(F.explode("found").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_docs"))


# --- outlines


@query(f"WITH {SQL_OUTLINE} SELECT doc_id, list_index, CASE WHEN physical_index <= n // 2 THEN physical_index END AS physical_index FROM ol JOIN np USING (doc_id)")
def index_truncation(spark, sf):
    items = _outline(spark, sf).join(_n_pages(spark, sf), "doc_id")
    return outline.drop_beyond(items, F.expr("n div 2")).select("doc_id", "list_index", "physical_index")


_SQL_PAIRS = f"""WITH {SQL_OUTLINE}, pairs AS (SELECT l.doc_id, r.title, l.page, r.physical_index, r.list_index AS ri, l.list_index AS li FROM ol r JOIN ol l ON l.doc_id = r.doc_id AND l.title IS NOT DISTINCT FROM r.title WHERE r.physical_index >= 2)"""


@query(f"{_SQL_PAIRS} SELECT doc_id, title, page, physical_index FROM pairs")
def title_matches(spark, sf):
    items = _outline(spark, sf)
    return outline.match_titles(items, items, 2).drop("pos_")


_SQL_OFFSET = f"""{_SQL_PAIRS}, d AS (SELECT doc_id, physical_index - page AS d, count(*) AS n, min(ri * 1000000 + li) AS f FROM pairs GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM d) """


@query(f"{_SQL_OFFSET} SELECT doc_id, d AS page_offset FROM w WHERE k = 1")
def page_offset(spark, sf):
    items = _outline(spark, sf)
    return outline.page_offset(outline.match_titles(items, items, 2))


@query(f"{_SQL_OFFSET} SELECT ol.doc_id, list_index, CASE WHEN d IS NULL THEN physical_index ELSE page + d END AS physical_index, CASE WHEN d IS NULL THEN page END AS page FROM ol LEFT JOIN (SELECT doc_id, d FROM w WHERE k = 1) USING (doc_id)")
def offset_application(spark, sf):
    items = _outline(spark, sf)
    return outline.apply_offset(items, outline.page_offset(outline.match_titles(items, items, 2))).select("doc_id", "list_index", "physical_index", "page")


@query(f"""WITH {SQL_OUTLINE} SELECT doc_id, list_index, previous, following FROM (SELECT *, coalesce(last_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous,
coalesce(first_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS following FROM ol) WHERE NOT has_physical_index""")
def anchor_fill(spark, sf):
    return outline.missing_items(_outline(spark, sf)).select("doc_id", "list_index", "previous", "following")


@query(f"""WITH {SQL_OUTLINE}, g AS (SELECT *, CASE WHEN answer = 'yes' THEN physical_index END AS good FROM ol) SELECT doc_id, list_index, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous,
coalesce(first_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n)::INT AS following FROM g JOIN np USING (doc_id)""")
def anchor_fix(spark, sf):
    items = _outline(spark, sf).join(_n_pages(spark, sf), "doc_id")
    return outline.correct_anchors(items, F.col("answer") != "yes", "n").select("doc_id", "list_index", "previous", "following")


@query(f"WITH {SQL_OUTLINE} SELECT doc_id, list_index, CASE WHEN answer = 'no' AND list_index % 2 = 0 THEN 1 ELSE physical_index END AS physical_index FROM ol")
def index_write_back(spark, sf):
    items = _outline(spark, sf)
    fixed = items.filter("answer = 'no'").select("doc_id", "list_index", F.lit(1).alias("physical_index"), (F.col("list_index") % 2 == 0).alias("is_valid"))
    return outline.write_back(items, fixed)[0].select("doc_id", "list_index", "physical_index")


@query(f"""WITH {SQL_OUTLINE}, f AS (SELECT doc_id, arg_min(CASE WHEN physical_index IS NULL THEN -1 ELSE physical_index END, list_index) AS p FROM ol GROUP BY 1)
SELECT doc_id, list_index, structure, title, physical_index FROM ol UNION ALL SELECT doc_id, -1, '0', 'Preface', 1 FROM f WHERE p > 1""")
def preface_rows(spark, sf):
    return outline.with_preface(_outline(spark, sf)).select("doc_id", "list_index", "structure", "title", "physical_index")


@query(f"WITH {SQL_RANGES} SELECT doc_id, list_index, start_index, end_index FROM rg")
def section_ranges(spark, sf):
    return _ranged(spark, sf).select("doc_id", "list_index", "start_index", "end_index")


@query(f"""WITH {SQL_OUTLINE}, v AS (SELECT doc_id, max(n) AS n, arg_max(physical_index, list_index) FILTER (physical_index IS NOT NULL) AS last, avg(CASE WHEN answer = 'yes' THEN 1.0 ELSE 0.0 END) FILTER (physical_index IS NOT NULL) AS a,
coalesce(list(list_index ORDER BY list_index) FILTER (physical_index IS NOT NULL AND answer <> 'yes'), []) AS f FROM ol JOIN np USING (doc_id) GROUP BY 1),
r AS (SELECT doc_id, CASE WHEN last IS NULL OR last < n / 2 THEN 0.0 ELSE a END AS accuracy, CASE WHEN last IS NULL OR last < n / 2 THEN [] ELSE f END AS failures FROM v)
SELECT doc_id, round(accuracy, 6) AS accuracy, failures, CASE WHEN accuracy = 1 AND len(failures) = 0 THEN 'accept' WHEN accuracy > 0.6 AND len(failures) > 0 THEN 'fix' ELSE 'fall_back' END AS next FROM r""")
def verify_accuracy(spark, sf):
    items = _outline(spark, sf).join(_n_pages(spark, sf), "doc_id")
    out = outline.verification(items, "n")
    return out.select("doc_id", F.round("accuracy", 6).alias("accuracy"), "failures", outline.route("accuracy", F.size("failures")).alias("next"))


# --- trees


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.build(_ranged(spark, sf))


@query(f"WITH {SQL_NODES} SELECT doc_id, list_index, parent_index, depth, node_id FROM nodes_")
def outline_tree(spark, sf):
    return _nodes(spark, sf).select("doc_id", "list_index", "parent_index", "depth", "node_id")


_SQL_HELD = f"WITH {SQL_NODES}, h AS (SELECT pg.doc_id, pg.page_index, arg_max(node_id, preorder) AS node_id FROM pg JOIN nodes_ n ON pg.doc_id = n.doc_id AND pg.page_index BETWEEN n.start_index AND n.end_index GROUP BY 1, 2)"


@query(f"{_SQL_HELD} SELECT doc_id, page_index, node_id FROM h")
def page_to_node(spark, sf):
    return tree.pages_to_nodes(_pages(spark, sf), _nodes(spark, sf))


@query(f"WITH {SQL_RANGES} SELECT DISTINCT pg.doc_id, pg.page_index FROM pg JOIN rg ON pg.doc_id = rg.doc_id AND pg.page_index BETWEEN rg.start_index AND rg.end_index")
def node_page_set(spark, sf):
    return tree.node_pages(_ranged(spark, sf))


def _sql_part(cond: str) -> str:
    return f"coalesce((SELECT string_agg(pg.text, '' ORDER BY pg.page_index) FROM pg WHERE pg.doc_id = n.doc_id AND {cond}), '')"


@query(f"""WITH {SQL_NODES} SELECT doc_id, node_id, '<<<context-before>>>' || chr(10) || {_sql_part("pg.page_index BETWEEN n.start_index - 1 AND n.end_index + 1 AND pg.page_index < n.start_index")} || chr(10) || '<<<section-content>>>' || chr(10) ||
{_sql_part("pg.page_index BETWEEN n.start_index AND n.end_index")} || chr(10) || '<<<context-after>>>' || chr(10) || {_sql_part("pg.page_index BETWEEN n.start_index - 1 AND n.end_index + 1 AND pg.page_index > n.end_index AND pg.page_index >= n.start_index")} AS text FROM nodes_ n""")
def node_text(spark, sf):
    return tree.paged_texts(_nodes(spark, sf), _paged(spark, sf), overlap=1)


@query(f"WITH {SQL_NODES}, w AS (SELECT n.doc_id, node_id, sum(tokens) AS n_tokens FROM nodes_ n JOIN pg ON pg.doc_id = n.doc_id AND pg.page_index BETWEEN n.start_index AND n.end_index WHERE n.end_index - n.start_index > 2 GROUP BY 1, 2) SELECT doc_id, node_id, n_tokens::BIGINT AS n_tokens FROM w WHERE n_tokens >= 100")
def large_nodes(spark, sf):
    return tree.large(_nodes(spark, sf), _pages(spark, sf), 2, 100).select("doc_id", "node_id", "n_tokens")


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id FROM nodes_ n WHERE NOT EXISTS (SELECT 1 FROM nodes_ c WHERE c.doc_id = n.doc_id AND c.parent_index = n.list_index)")
def leaf_nodes(spark, sf):
    return tree.leaves(_nodes(spark, sf)).select("doc_id", "node_id")


@query(f"""WITH {SQL_NODES}, c2 AS (SELECT doc_id, parent_index, string_agg('[' || node_id || '] ' || title || chr(10) || CASE WHEN title = '' THEN '(no summary)' ELSE title END, chr(10) || chr(10) ORDER BY list_index) AS b FROM nodes_ WHERE depth = 2 GROUP BY 1, 2),
s1 AS (SELECT n.*, CASE WHEN c2.b IS NULL THEN n.title ELSE n.title || ': ' || c2.b END AS s FROM nodes_ n LEFT JOIN c2 ON n.doc_id = c2.doc_id AND n.list_index = c2.parent_index AND n.depth = 1),
c1 AS (SELECT doc_id, parent_index, string_agg('[' || node_id || '] ' || title || chr(10) || s, chr(10) || chr(10) ORDER BY list_index) AS b FROM s1 WHERE depth = 1 GROUP BY 1, 2)
SELECT s1.doc_id, node_id, CASE WHEN c1.b IS NULL THEN s ELSE title || ': ' || c1.b END AS summary FROM s1 LEFT JOIN c1 ON s1.doc_id = c1.doc_id AND s1.list_index = c1.parent_index AND s1.depth = 0""")
def bottom_up_summary(spark, sf):
    return tree.bottom_up(_nodes(spark, sf), "title", lambda title, blocks: F.concat(title, F.lit(": "), blocks))


@query()
def nested_tree(spark, sf):
    return tree.to_nested(_nodes(spark, sf))


@query(f"WITH {SQL_NODES} SELECT n.doc_id, n.preorder, p.preorder AS parent, n.depth, n.title, n.node_id, n.start_index, n.end_index, NULL::VARCHAR AS summary FROM nodes_ n LEFT JOIN nodes_ p ON n.doc_id = p.doc_id AND n.parent_index = p.list_index")
def flattened_tree(spark, sf):
    """Nested trees read back as flat nodes."""
    return tree.from_nested(tree.to_nested(_nodes(spark, sf)))


@query(f"WITH {SQL_NODES} SELECT doc_id, count(*) AS n_nodes FROM nodes_ GROUP BY 1")
def node_counts(spark, sf):
    return tree.node_counts(_nodes(spark, sf))


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id, coalesce((SELECT list('p' || pg.page_index ORDER BY pg.page_index) FROM pg WHERE pg.doc_id = n.doc_id AND pg.tokens % 2 = 0 AND pg.page_index BETWEEN n.start_index AND n.end_index), []) AS images FROM nodes_ n")
def page_images(spark, sf):
    images = _pages(spark, sf).filter("tokens % 2 = 0").select("doc_id", "page_index", F.concat(F.lit("p"), "page_index").alias("path"))
    return tree.page_images(_nodes(spark, sf), images)


@query(f"""{_SQL_HELD}, e AS (SELECT pg.doc_id, page_index, list_distinct(regexp_extract_all(text, '[A-Z]{{4,}}')) AS w FROM pg)
SELECT doc_id, node_id, count(*) AS n_pages, coalesce(sum(tokens), 0)::BIGINT AS n_tokens, sum(len(w))::BIGINT AS n_capitals FROM h JOIN pg USING (doc_id, page_index) JOIN e USING (doc_id, page_index) GROUP BY 1, 2""")
def sections_with_entities(spark, sf):
    """The flagship: pages by section, with what was found on them."""
    held = tree.pages_to_nodes(_pages(spark, sf), _nodes(spark, sf))
    p = _pages(spark, sf).withColumn("w", F.size(F.array_distinct(E.pattern_hits("text", "[A-Z]{4,}"))))
    return held.join(p, ["doc_id", "page_index"]).groupBy("doc_id", "node_id").agg(F.count("*").alias("n_pages"), F.sum("tokens").cast("long").alias("n_tokens"), F.sum("w").cast("long").alias("n_capitals"))


# --- replies


_FIGURE = """case doc_id % 4 when 0 then concat('<analyze>[{"titles":"', lang, '","legends":""}]</analyze>') when 1 then concat('<ANALYZE>[{"titles":"', lang, '"},{"x_la') when 2 then '<div data-bbox="1 2 3 4" data-label="Text"><p>a</p></div>' else '' end"""


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'figure_analysis' WHEN 1 THEN 'figure_analysis' WHEN 2 THEN 'layout_html' END AS format,
CASE WHEN doc_id % 4 < 2 THEN doc_id % 4 = 1 END AS truncated, CASE WHEN doc_id % 4 < 2 THEN '"' || lang || '"' END AS title, CASE WHEN doc_id % 4 < 2 THEN 1 END AS n_panels FROM documents""")
def figure_panels(spark, sf):
    c = F.expr(_FIGURE)
    rows = _read(spark, sf, "documents").select("doc_id", X.reply_format(c).alias("format"), F.when(X.reply_format(c) == "figure_analysis", X.figure_body(c)).alias("body"))
    p = F.when(F.col("body").isNotNull(), X.panels("body.json"))
    return rows.select("doc_id", "format", F.col("body.truncated").alias("truncated"), p[0]["title"].alias("title"), F.when(F.col("body").isNotNull(), F.size(p)).alias("n_panels"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'figure_analysis' WHEN doc_id % 4 = 2 THEN 'layout_html' WHEN lang IS NOT NULL THEN 'unknown' END AS format, CASE WHEN doc_id % 4 < 2 THEN doc_id % 4 = 1 END AS truncated,
CASE WHEN doc_id % 8 IN (1, 4) THEN 0 WHEN doc_id % 4 < 2 THEN 1 END AS n_panels, CASE WHEN doc_id % 8 = 1 THEN 'unrecoverable' WHEN doc_id % 8 = 4 THEN 'json' END AS error, CASE WHEN doc_id % 4 = 3 THEN substr(lang || ' ' || text, 1, 500) END AS raw_head FROM documents""")
def reply_envelope(spark, sf):
    c = F.expr("""case when doc_id % 8 = 1 then '<analyze>[{"titles' when doc_id % 8 = 4 then concat('<analyze>', lang, '{</analyze>') when doc_id % 4 = 0 then concat('<analyze>{"titles":"', lang, '"}</analyze>')
        when doc_id % 4 = 1 then concat('<analyze>[{"titles":"', lang, '"},{"x_la') when doc_id % 4 = 2 then concat('<div data-label="Text">', text) else concat(lang, ' ', text) end""")
    e = _read(spark, sf, "documents").select("doc_id", X.envelope(c).alias("e"))
    return e.select("doc_id", "e.format", "e.truncated", F.when(F.col("e.panels").isNotNull(), F.size("e.panels")).alias("n_panels"), "e.error", "e.raw_head")


@query("""SELECT doc_id, '<div class="analysis-block"><h4>' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Subplot 1' END || '</h4><dl><dt>X Labels</dt><dd>' || source || '</dd></dl></div>' AS html, [{'series': lang, 'x': doc_id::VARCHAR}, {'series': 'b', 'x': '2'}] AS points FROM documents""")
def panel_rendering(spark, sf):
    body = F.expr("""concat('[{', if(doc_id % 2 = 0, concat('"titles":"', lang, '",'), ''), '"x_labels":"', source, '"}]')""")
    reply = F.concat(F.lit("<analyze>"), body, F.expr("""concat('</analyze> [[{"series":"', lang, '","x":', doc_id, '}],{"series":"b","x":2}]')"""))
    points = F.transform(X.trailing_points(reply), lambda p: F.struct(p["series"].alias("series"), p["x"].alias("x")))
    return _read(spark, sf, "documents").select("doc_id", X.render_panels(X.figure_body(reply)["json"]).alias("html"), points.alias("points"))


@query("""SELECT page_id, unnest([0, 1])::INT AS block_index, unnest(['Text', 'Math']) AS label, unnest([[1, 2, 3, page_id::INT], NULL]) AS bbox, unnest(['page ' || page_id, 'x 1']) AS text FROM pages""")
def layout_blocks(spark, sf):
    html = F.expr("""concat('skip<div data-bbox="1 2 3 ', page_id, '" data-label="Text"><div><p>page ', page_id, '</p></div></div><div data-label="Math"><math>x</math> <b>1</b></div><div data-label="open">lost')""")
    pages_ = _read(spark, sf, "pages").select("page_id", html.alias("html"))
    return _blocks(pages_)


def _blocks(pages_: DataFrame) -> DataFrame:
    found = pages_.select("page_id", F.posexplode(X.blocks("html")).alias("block_index", "b"))
    return found.select("page_id", "block_index", F.col("b.label").alias("label"), T.parse_bbox("b.bbox").alias("bbox"), X.block_columns("b.html")["text"].alias("text"))


# --- layout

_LABELS = "element_at(array('figure', 'table', 'isolate_formula', 'figure_caption', 'table_caption', 'plain text', 'abandon'), cast(l_partkey % 7 as int) + 1)"
_SQL_DET = """det AS (SELECT l_orderkey % 50 AS doc_id, (l_orderkey // 50 + 1)::INT AS page_index, l_linenumber::INT AS det_index,
(['figure', 'table', 'isolate_formula', 'figure_caption', 'table_caption', 'plain text', 'abandon'])[(l_partkey % 7 + 1)::INT] AS label, (l_suppkey % 100) / 100.0 AS confidence,
(l_partkey % 300)::INT AS x0, (l_suppkey % 400)::INT AS y0, (l_partkey % 300 + 100)::INT AS x1, (l_suppkey % 400 + 60)::INT AS y1, CASE WHEN l_linenumber % 2 = 0 THEN 'c' ELSE '' END AS caption FROM lineitem)"""


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 50 as doc_id", "cast(l_orderkey div 50 + 1 as int) as page_index", "cast(l_linenumber as int) as det_index", f"{_LABELS} as label", "(l_suppkey % 100) / 100.0d as confidence",
        "cast(l_partkey % 300 as int) as x0", "cast(l_suppkey % 400 as int) as y0", "cast(l_partkey % 300 + 100 as int) as x1", "cast(l_suppkey % 400 + 60 as int) as y1", "if(l_linenumber % 2 = 0, 'c', '') as caption",
    )


@query(f"WITH {_SQL_DET} SELECT doc_id, page_index, det_index, CASE WHEN label IN ('plain text', 'figure_caption', 'table_caption') THEN 'text' ELSE 'non_text' END AS kind FROM det WHERE confidence >= 0.25 AND label <> 'abandon'")
def detection_filter(spark, sf):
    return layout.split_text(layout.wanted(_detections(spark, sf), without=("abandon",))).select("doc_id", "page_index", "det_index", "kind")


@query(f"WITH {_SQL_DET} SELECT doc_id, page_index, det_index, {{'x0': x0 / 1000, 'y0': y0 / 1000, 'x1': x1 / 1000, 'y1': y1 / 1000}} AS norm, {{'x0': trunc(x0 * 1.5)::INT, 'y0': trunc(y0 * 1.5)::INT, 'x1': trunc(x1 * 1.5)::INT, 'y1': trunc(y1 * 1.5)::INT}} AS px, {{'x0': x0 * 72 / 200, 'y0': y0 * 72 / 200, 'x1': x1 * 72 / 200, 'y1': y1 * 72 / 200}} AS pt FROM det")
def boxes(spark, sf):
    return _detections(spark, sf).select("doc_id", "page_index", "det_index", layout.normalized(F.lit(1000), F.lit(1000)).alias("norm"), layout.scaled().alias("px"), layout.points().alias("pt"))


@query(f"WITH {_SQL_DET} SELECT doc_id, page_index, det_index, CASE label WHEN 'figure' THEN 'fig' WHEN 'table' THEN 'tbl' WHEN 'isolate_formula' THEN 'eq' ELSE 'el' END || '_doc_' || format('{{:04d}}', page_index) || '_' || lpad((row_number() OVER (PARTITION BY doc_id, page_index, label ORDER BY det_index))::VARCHAR, 3, '0') AS element_id FROM det")
def element_ids(spark, sf):
    return layout.with_ids(_detections(spark, sf)).select("doc_id", "page_index", "det_index", "element_id")


@query(f"WITH {_SQL_DET} SELECT doc_id, count(*) FILTER (label = 'figure') AS n_figure, count(*) FILTER (label = 'table') AS n_table, count(*) FILTER (label = 'isolate_formula') AS n_isolate_formula, count(*) FILTER (caption <> '') AS n_captions, count(DISTINCT page_index) AS pages_with_elements, count(*) AS n_elements FROM det GROUP BY 1")
def element_counts(spark, sf):
    return layout.counts(_detections(spark, sf))


@query(f"WITH {_SQL_DET} SELECT page_index AS image, (doc_id % 2)::VARCHAR AS method, count(*) FILTER (label IN ('plain text', 'figure_caption', 'table_caption')) AS n_text, count(*) FILTER (label NOT IN ('plain text', 'figure_caption', 'table_caption')) AS n_non_text FROM det GROUP BY 1, 2")
def region_counts(spark, sf):
    d = layout.split_text(_detections(spark, sf)).selectExpr("*", "page_index as image", "cast(doc_id % 2 as string) as method")
    return layout.region_counts(d)


@query(f"""WITH RECURSIVE {_SQL_DET}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY det_index) AS r FROM det WHERE label IN ('figure', 'table', 'isolate_formula')),
c AS (SELECT doc_id, page_index, list({{'i': det_index, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY det_index) AS caps FROM det WHERE label IN ('figure_caption', 'table_caption') GROUP BY 1, 2),
f AS (SELECT e.*, coalesce(caps, []) AS caps FROM e LEFT JOIN c USING (doc_id, page_index)),
w AS (SELECT doc_id, page_index, 0::BIGINT AS r, NULL::INT AS det_index, NULL::BIGINT AS caption_index, []::INT[] AS used FROM f WHERE r = 1
  UNION ALL SELECT doc_id, page_index, r, det_index, best, CASE WHEN best IS NULL THEN used ELSE list_append(used, best::INT) END FROM (
    SELECT f.doc_id, f.page_index, f.r, f.det_index, w.used, list_sort(list_filter(list_transform(list_filter(f.caps, lambda k: NOT list_contains(w.used, k.i) AND abs(f.x0 + f.x1 - k.x0 - k.x1) / 2 <= (f.x1 - f.x0) * 0.6),
      lambda k: {{'g': CASE WHEN k.y0 - f.y1 BETWEEN 0 AND 80 THEN k.y0 - f.y1 WHEN f.y0 - k.y1 BETWEEN 0 AND 80 THEN f.y0 - k.y1 END, 'i': k.i}}), lambda x: x.g IS NOT NULL))[1].i AS best
    FROM w JOIN f ON w.doc_id = f.doc_id AND w.page_index = f.page_index AND f.r = w.r + 1))
SELECT doc_id, page_index, det_index, caption_index FROM w WHERE r > 0""")
def caption_pairs(spark, sf):
    return layout.captions(_detections(spark, sf))


# --- runs and results

_SQL_CALLS = "calls AS (SELECT event_type AS model, value AS seconds, event_type = 'error' AS error, length(props)::BIGINT AS input_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 END AS output_tokens, event_id FROM events)"


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").selectExpr("event_type as model", "value as seconds", "event_type = 'error' as error", "cast(length(props) as bigint) as input_tokens", "if(event_id % 3 = 0, null, event_id % 11) as output_tokens", "event_id")


@query(f"WITH {_SQL_CALLS} SELECT model, count(*) AS n_calls, round(sum(seconds), 2) AS total_s, round(avg(seconds), 4) AS avg_s, count(*) FILTER (error) AS n_errors, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS total_tokens FROM calls GROUP BY 1")
def llm_metrics(spark, sf):
    return metrics.call_metrics(_calls(spark, sf), None).withColumns({"total_s": F.round("total_s", 2), "avg_s": F.round("avg_s", 4)})


@query(f"WITH {_SQL_CALLS} SELECT count(*) AS n_calls, round(coalesce(sum(seconds), 0), 2) AS total_s, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens FROM calls")
def token_totals(spark, sf):
    return metrics.grand_totals(_calls(spark, sf)).withColumn("total_s", F.round("total_s", 2))


@query("SELECT user_id AS run, event_type AS stage, arg_max(value, event_id) AS seconds FROM events GROUP BY 1, 2")
def stage_durations(spark, sf):
    return metrics.stage_durations(_read(spark, sf, "events").selectExpr("user_id as run", "event_type as stage", "value as seconds", "event_id as seq"))


@query("SELECT event_type AS stage, count(*) AS n_calls, round(sum(value), 2) AS total_s, round(avg(value), 4) AS avg_s FROM events GROUP BY 1")
def stage_calls(spark, sf):
    out = metrics.stage_calls(_read(spark, sf, "events").selectExpr("event_type as stage", "value as seconds"))
    return out.withColumns({"total_s": F.round("total_s", 2), "avg_s": F.round("avg_s", 4)})


@query("SELECT user_id AS run, event_type AS key, arg_max(event_id % 7, event_id) AS value FROM events GROUP BY 1, 2")
def run_counters(spark, sf):
    return metrics.counters(_read(spark, sf, "events").selectExpr("user_id as run", "event_type as key", "event_id % 7 as value", "event_id as seq"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS system, coalesce(list({'role': role, 'content': text} ORDER BY turn) FILTER (role <> 'system'), []) AS messages FROM conversations GROUP BY 1")
def message_split(spark, sf):
    return metrics.messages(_read(spark, sf, "conversations"))


_NAME = "concat(source, '_p', doc_id % 5, '_fig_', doc_id % 3, '_', lang, '_chart.md')"


@query("SELECT source AS pdf_stem, (doc_id % 5)::VARCHAR AS page, 'fig_' || (doc_id % 3) AS img, list({'name': source || '_p' || (doc_id % 5) || '_fig_' || (doc_id % 3) || '_' || lang || '_chart.md', 'model': lang, 'task': 'chart'} ORDER BY lang) AS members FROM (SELECT DISTINCT source, doc_id % 15 AS doc_id, lang FROM documents) GROUP BY 1, 2, 3")
def result_groups(spark, sf):
    files = _read(spark, sf, "documents").selectExpr("source", "doc_id % 15 as doc_id", "lang").distinct().select(F.expr(_NAME).alias("name"))
    return results.grouped(results.with_keys(files))


@query("""WITH p AS (SELECT user_id AS key, event_id AS i, event_type AS series, round(value, 1)::VARCHAR AS y, event_id % 2 = 0 AS two FROM events)
SELECT key, series, 'y' AS col, i AS point_index, y AS cell FROM p UNION ALL SELECT p.key, p.series, 'z', p.i, CASE WHEN two THEN 'z' || i ELSE '' END FROM p WHERE key IN (SELECT key FROM p WHERE two)""")
def series_tables(spark, sf):
    p = _read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("point_index"), F.expr("map_filter(map('series', event_type, 'y', cast(round(value, 1) as string), 'z', if(event_id % 2 = 0, concat('z', event_id), null)), (k, v) -> v is not null)").alias("point"))
    return results.series_points(p).select("key", "series", F.col("column").alias("col"), "point_index", "cell")


# --- model-backed steps by rules


def _run_path(spark: SparkSession) -> str:
    import uuid

    from ..sources.shared import shared_dir

    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@query()
def build_trees(spark, sf):
    """Documents to summarised trees."""
    from ..provider import RuleProvider
    from .build import build

    return build(_read(spark, sf, "documents").select("doc_id", "text"), RuleProvider(), _run_path(spark))


@query()
def enriched_trees(spark, sf):
    """Elements recognised, put in their nodes, and the nodes summarised again with them."""
    from ..provider import RuleProvider
    from . import enrich

    nodes = _nodes(spark, sf).withColumn("summary", F.col("title"))
    found = layout.with_ids(layout.wanted(_detections(spark, sf), layout.CONTENT)).withColumn("asset_path", F.when(F.col("det_index") % 3 > 0, F.concat_ws("/", F.lit("a"), "element_id")))
    path = _run_path(spark)
    placed = enrich.assigned(enrich.recognised(found, RuleProvider(), path), nodes)
    return enrich.resummarised(nodes, placed, RuleProvider(), path).select("doc_id", "node_id", "summary")


@query()
def title_checks(spark, sf):
    from ..provider import RuleProvider, ask

    items = outline.located(_outline(spark, sf)).join(_pages(spark, sf).select("doc_id", F.col("page_index").alias("physical_index"), "text"), ["doc_id", "physical_index"])
    requests = items.select(F.concat_ws("-", "doc_id", "list_index").alias("key"), F.lit("check_title_appearance_in_start").alias("prompt"), F.create_map(F.lit("title"), "title", F.lit("page_text"), "text").alias("inputs"))
    return ask(requests, RuleProvider(), json_mode=True)


@query()
def node_summaries(spark, sf):
    from ..provider import RuleProvider, ask

    texts = tree.paged_texts(_nodes(spark, sf), _paged(spark, sf), overlap=1)
    requests = texts.select(F.concat_ws("-", "doc_id", "node_id").alias("key"), F.lit("generate_node_summary").alias("prompt"), F.create_map(F.lit("node_text"), "text").alias("inputs"))
    return ask(requests, RuleProvider())
