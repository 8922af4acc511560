import os

import duckdb
import pytest

from quirework.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    out = catalogue.QUERIES[name](spark, DATA)
    rows = out.collect()
    if name in catalogue.ORACLES:
        cols = sorted(out.columns)
        want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
        plain = lambda v: tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else tuple(plain(x) for x in v.values()) if isinstance(v, dict) else round(v, 6) if isinstance(v, float) else v
        assert sorted((str(plain(tuple(r[c] for c in cols))) for r in rows)) == sorted(str(plain(r)) for r in want)


def test_captions_of_one_number_serve_once(spark, tmp_path):
    # a figure and a table above two captions with the same det_index; on the second page those have two
    lines = [(page, part, supp, n) for page, other in ((1, 3), (51, 4)) for part, supp, n in ((0, 0, 1), (1, 0, 2), (3, 70, 3), (10, 90, other))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((tuple(r) for r in catalogue.QUERIES["caption_pairs"](spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, 1, 1, 3), (1, 1, 2, None), (1, 2, 1, 3), (1, 2, 2, 4)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT doc_id, page_index, det_index, caption_index FROM ({catalogue.ORACLES['caption_pairs']})").fetchall(), key=str) == got


def test_entities_of_all_languages(spark, tmp_path):
    docs = [(1, "NaClO4 in PC", "en"), (2, "NaBF4 在 DME 中", "zh"), (3, "Lösung von NaFSI", None), (4, None, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    salts = {r.doc_id: r.salts for r in catalogue.QUERIES["formula_entities"](spark, str(tmp_path)).collect()}
    assert salts == {1: ["NaClO4", "NaPF6"], 2: ["NaBF4", "NaPF6"], 3: ["NaFSI", "NaPF6"], 4: []}
    found = {r.doc_id: set(r.found) for r in catalogue.QUERIES["document_entities"](spark, str(tmp_path)).collect()}
    assert {"NaBF4", "DME"} <= found[2] and "NaFSI" in found[3] and found[4] == set()
    counts = {r.entity: r.n_docs for r in catalogue.QUERIES["entity_doc_counts"](spark, str(tmp_path)).collect()}
    assert counts["NaPF6"] == 3 and counts["NaBF4"] == 1


def test_whole_texts_and_titles(spark, tmp_path):
    line = "a line of well over twenty-four characters"
    docs = [(1, f"{line} A..... 5\n{line} B\n{line} C . . . . . . 9")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cleaned = catalogue.QUERIES["dot_leader_clean"](spark, str(tmp_path)).first().cleaned
    assert cleaned == f"{line} A:  5\n{line} B\n{line} C : 9: 1 x: "
    titles = {r.title for r in catalogue._outline(spark, str(tmp_path)).collect()}
    assert titles == {f"{line} B", f"{line} A..... 5"}
