"""The stages, and the whole pipeline, against plain versions on a small corpus."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quirework.llm import sharding

from ._brute import components, contamination, spaced

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(23)
    stems = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["der", "und", "lich", "ße", "keit"]}
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(1, 5)))
    text = lambda x, n: " ".join(word(stems[x]) for _ in range(n))
    items = [(i, text("aa", 25)) for i in range(4)]
    docs = []
    for i in range(260):
        x = rng.choice(list(stems))
        docs.append((i, text(x, rng.randrange(8, 120)), x, rng.choice(["s0", "s0", "s1", "s2"]), 0))
    for i in range(260, 300):
        d = docs[rng.randrange(100)]
        w = d[1].split(" ")
        w[-1:] = ["changed"] if i % 2 else w[-1:]
        docs.append((i, " ".join(w), d[2], d[3], 0))
    for i in range(300, 310):
        docs.append((i, text("aa", 20) + " " + items[i % 4][1], "aa", "s1", 0))
    docs += [(400, None, "aa", "s0", None), (401, "", None, None, 0), (402, "123 456 --", "bb", "s2", 10)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages_and_run(spark, tables):
    path, docs, items = tables
    current = spark.read.parquet(f"{path}/documents.parquet")
    states = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, current, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == current.columns
        rows = [tuple(r) for r in after.collect()]
        states.append(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            current = spark.createDataFrame(rows, DOCS)
    language, unique, clean, mixed, final = states
    assert {r[0] for r in docs} - {r[0] for r in language} <= {400, 401, 402} | set(range(310)) and not {400, 401, 402} & {r[0] for r in language}
    assert len(language) >= 0.98 * 310
    parts = components([r[:2] for r in language])
    assert sorted(r[0] for r in unique) == sorted({c for _, _, c in parts})
    dirty = {r[0] for r in contamination([r[:2] for r in unique], items) if r[5]}
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in unique if r[0] not in dirty) and dirty & set(range(300, 310))
    copies = Counter(r[0] for r in mixed)
    assert set(copies) <= {r[0] for r in clean} and max(copies.values()) <= 3
    words = Counter()
    for r in mixed:
        words[r[3]] += len(spaced(r[1]))
    assert abs(sum(words.values()) - sum(len(spaced(r[1])) for r in clean)) < 0.1 * sum(words.values())
    sizes = Counter(r[-2] for r in final)
    assert len(final) == len(mixed) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r[-1] for r in final if r[-2] == s) == list(range(n)) for s, n in sizes.items())
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*current.columns, "shard", "slot"]
    assert Counter(map(tuple, out.collect())) == Counter(final)


def test_stages_on_an_empty_table(spark, tables, tmp_path):
    path, _, items = tables
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


def test_sharding_keeps_clashing_columns(spark):
    d = spark.createDataFrame([(1, "t", "s", "mine", 3)], "doc_id long, text string, source string, shard string, place long")
    assert sharding.interleave(d, 8).columns == [*d.columns, "shard_", "slot_", "place_"]
