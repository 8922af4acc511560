import random
from collections import Counter, defaultdict

import pytest

from quirework.llm import decontaminate, mixing, sharding

from ._brute import contamination, spaced

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "x y z", "en", None, 5), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "\x00 \t\n\x0b", "en", "a", 4), (3, "\x00 \t\n\x0b", "en", "a", 4)]


def prose(rng, n, vocabulary=30):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(rng):
    items = [(i, prose(rng, n, 12)) for i, n in enumerate([40, 25, 10, 3, 1, 0, 12, 12])]
    items += [(20, None), (None, "Lone Item here"), (3, "second TEXT of three")]
    docs = list(ODD)
    for i in range(60):
        words = prose(rng, rng.choice([0, 5, 30, 200])).split(" ")
        if i % 3 == 0:
            item = items[i % len(items)][1] or ""
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in item.split(" ")[: rng.randrange(1, 41)]]
        docs.append((10 + i, " ".join(words), "en", f"s{i % 4}", 0))
    docs.append((100, prose(rng, 30_000), "en", "s0", 0))
    docs.append((101, items[0][1] + " é ß " + items[0][1], "en", "s0", 0))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination_equals_brute_force(spark, block_bytes):
    docs, items = corpus(random.Random(1))
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontaminate.report(spark, d, b, block_bytes=block_bytes).collect()), key=str)
    want = contamination([(r[0], r[1]) for r in docs], items)
    assert got == sorted(want, key=str)
    kept = decontaminate.decontaminate(spark, d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r[0] for r in want if not r[5] and r[0] is not None)


def test_longest_matches_have_the_right_words(spark):
    docs, items = corpus(random.Random(2))
    from ._brute import alnum

    text, item = defaultdict(list), defaultdict(list)
    for r in docs:
        text[r[0]].append(alnum(r[1]))
    for i, t in items:
        item["" if i is None else str(i)].append(alnum(t))
    rows = decontaminate.matches(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert rows
    for r in rows:
        assert any(a[r.doc_start : r.doc_start + r.n_words] == b[r.item_start : r.item_start + r.n_words] for a in text[r.doc_id] for b in item[r.item_id])


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(spark, d, b).count() == 0
    some = spark.createDataFrame(ODD, DOCS)
    assert {r.n_hit for r in decontaminate.report(spark, some, b).collect()} == {0}
    assert decontaminate.decontaminate(spark, some, b).count() == len(ODD)


def test_targets_are_filled_and_capped():
    t = mixing.targets([100, 100, 1000], [5, 2, 1])
    assert t == pytest.approx([300, 300, 600])
    assert mixing.targets([0, 10], [5, 2]) == [0, 10] and mixing.targets([], []) == []


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(3)
    docs = ODD + [(10 + i, prose(rng, rng.choice([1, 20, 50, 400])), "en", ["a", "b", "c", "d", "e"][i % 5 if i % 3 else 0], 0) for i in range(1500)]
    d = spark.createDataFrame(docs, DOCS).withColumn("size_", d_lit())
    out = mixing.allot(d).collect()
    again = mixing.allot(d.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again)) and len(out) == len(docs)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.size == 0 or r.taken % r.size == 0
    assert sizes == Counter({s: n for s, n in Counter(x for r in docs for x in [r[3]] * len(spaced(r[1]))).items()}) | Counter()
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(20, 0.02 * target[s]), (s, taken[s], target[s])
    mixed = mixing.mix_documents(d, seed=0)
    assert mixed.columns == d.columns
    assert mixed.count() == sum(r.copies for r in out)


def d_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_mix_of_empty_table(spark):
    d = spark.createDataFrame([], DOCS)
    assert mixing.allot(d).count() == 0 and mixing.mix_documents(d).count() == 0


@pytest.mark.parametrize("rows", [0, 3, 7, 500])
def test_shards_match_the_mixture(spark, rows):
    rng = random.Random(4)
    docs = (ODD if rows else []) + [(i, f"t{i % 90}", "en", rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(rows)]
    d = spark.createDataFrame(docs, DOCS)
    out = sharding.report(d).collect()
    assert len(out) == len(docs)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in by:
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
    if rows == 500:
        whole = Counter(r[3] for r in docs)
        for s in by:
            got = Counter(r.source for r in by[s])
            assert all(abs(got[x] - whole[x] / 8) <= 2 for x in whole)
        small = sharding.interleave(d, 8, bucket_rows=16).collect()
        key = lambda r: (str(r.doc_id), str(r.text), r.shard_, r.slot_)
        assert sorted(map(key, small)) == sorted(map(key, sharding.interleave(d.repartition(5), 8).collect()))


def test_sharding_sql(spark, tmp_path):
    import duckdb

    docs = ODD + [(i, f"t{i % 90}", "en", "abc"[i % 3], 0) for i in range(200)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    cols = "doc_id, size, law, shard, slot, source"
    want = con.sql(f"select {cols} from ({sharding.REPORT_SQL})").fetchall()
    got = [tuple(r) for r in sharding.report(spark.read.parquet(str(tmp_path / "d"))).select(*cols.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
