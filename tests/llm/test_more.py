"""Brute-force versions of what SQL cannot say, and the odd cases: clashing names, empty tables, one row repeated, long texts."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import ctw, decontaminate, jaccard, langid, mixing, passages, queries, secrets, sharding, topk, warc

from ._brute import spaced

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- parity bitmaps


def test_parity_bitmaps_never_differ_more_than_their_sets():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 32, 33, 500):
        for m in (n, n + n // 5, 2 * n + 3):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, m - n // 2).astype(np.uint64)]))
            a, b = jaccard._parity(x), jaccard._parity(y)
            assert jaccard._differing(a, b) == jaccard._differing(b, a) <= len(set(x.tolist()) ^ set(y.tolist()))
            assert jaccard._differing(a, a) == 0


# --- rounding by plain lists


def brute_copies(rows, weights, most, group_rows, fan):
    """rows: (key, source, size); {row number: copies} by the reduction tree on plain lists."""
    names = sorted({s for _, s, _ in rows})
    sizes = [sum(n for _, s, n in rows if s == x) for x in names]
    wanted = mixing.targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    copies, open_ = {}, defaultdict(list)
    for r, (key, s, n) in enumerate(rows):
        i = names.index(s)
        rate = wanted[i] / sizes[i] if sizes[i] else 0.0
        whole, p = int(rate // 1), rate % 1
        copies[r] = whole
        if 1e-12 <= p <= 1 - 1e-12:
            groups = max(1, max(1, sum(x == s for _, x, _ in rows) // group_rows) // 8)
            group = (i * 256 + int(np.floor(4 * np.log2(n + 1.0)))) * (1 << 32) + key % groups
            open_[group].append([n, key, p, r, i])
        else:
            copies[r] += round(p)
    draw = lambda key, level: float(mixing._draws(np.array([key], np.int64), 0, level)[0])
    level = 0
    while True:
        level += 1
        left = []
        for group, rows_ in open_.items():
            held = None
            for x in sorted(rows_, key=lambda x: (x[0], x[1])):
                if held is None:
                    held = x
                    continue
                a, b = held[2], x[2]
                t = draw(x[1], level)
                if a + b < 1:
                    loser, stays = (held, x) if t * (a + b) < b else (x, held)
                    loser[2], stays[2] = 0.0, a + b
                else:
                    winner, stays = (held, x) if t * (2 - a - b) < 1 - b else (x, held)
                    winner[2], stays[2] = 1.0, a + b - 1
                held = stays if 1e-12 < stays[2] < 1 - 1e-12 else None
                if held is None:
                    stays[2] = float(round(stays[2]))
            for x in rows_:
                if x[2] in (0.0, 1.0):
                    copies[x[3]] += int(x[2])
                else:
                    left.append((group, x))
        by = defaultdict(list)
        for group, x in sorted(left, key=lambda g: (g[1][4], g[0], g[1][1])):
            by[x[4]].append(x)
        if all(len(v) <= 1 for v in by.values()):
            return copies, {x[3]: x for v in by.values() for x in v}
        open_ = defaultdict(list)
        for i, v in by.items():
            for k, x in enumerate(v, 1):
                open_[i * (1 << 32) + k // fan].append(x)


def test_mix_equals_plain_rounding(spark):
    rng = random.Random(31)
    docs = [(i, prose(rng, rng.choice([1, 3, 20, 50, 400])), "en", rng.choice(["a", "a", "b", "c", "d"]), 0) for i in range(900)]
    d = spark.createDataFrame(docs, DOCS).repartition(5)
    group_rows = 16
    keyed = {r.doc_id: r.k for r in d.select("doc_id", F.xxhash64(F.lit(0), "doc_id", F.xxhash64("text")).alias("k")).collect()}
    want, last = brute_copies([(keyed[r[0]], r[3], len(spaced(r[1]))) for r in docs], mixing.WEIGHTS, mixing.MOST, group_rows, mixing.FAN)
    got = {r.doc_id: r.copies_ for r in mixing.copies(d, group_rows=group_rows).collect()}
    assert {i: n for i, n in got.items() if i not in last} == {i: n for i, n in want.items() if i not in last}
    # the last row of a source is rounded by its own draw
    assert all(got[i] - want[i] in (0, 1) for i in last) and len(last) <= 4


# --- a plain forward pass


def plain_features(text):
    """Buckets of a text's features: byte n-grams that touch a letter, and words."""
    low = [b if 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in text.encode()]
    out, mask = [], (1 << 32) - 1
    for k in langid.ORDERS:
        for i in range(len(low) - k + 1):
            if low[i] == 32 and low[i + 1] == 32:
                continue
            code = 0
            for b in low[i : i + k]:
                code = (code * 0x01000193 + b) & mask
            h = (code * 0x9E3779B1 + (k - 1) * 0x85EBCA77 % (1 << 32)) & mask
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & mask) >> 16)
    for w in bytes(low).split():
        x = 0
        for i, b in enumerate(w):
            x = (x + b * pow(langid.BASE, i, 1 << 64)) % (1 << 64)
        out.append(int(langid.mix(np.array([x], np.uint64))[0]) >> 48)
    return out


def test_predictions_equal_a_plain_forward_pass(spark):
    rng = random.Random(41)
    stems = {"aa": ["the", "and", "ing"], "bb": ["der", "und", "ße"], "cc": ["que", "eau", "É"]}
    docs = [(i, " ".join("".join(rng.choice(stems[x]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".", " 12"]) for _ in range(rng.randrange(1, 40))), x, "s", 0) for i in range(300) for x in [rng.choice(list(stems))]]
    d = spark.createDataFrame(docs, DOCS)
    model = langid.train(spark, langid.learnable(d))
    for r in langid.predict(spark, d, model, ["doc_id"]).collect():
        text = docs[r.doc_id][1]
        own = plain_features(text)
        z = sum((model.table[b].astype(float) for b in own), np.zeros(len(model.labels))) / max(len(own), 1) + model.bias
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        assert r.lang_pred == model.labels[int(p.argmax())] and r.score == pytest.approx(p.max(), rel=1e-4)


# --- passages against alignment of all pairs


def aligned_pairs(texts, least, identity):
    """Pairs whose best local alignment (1 for a match, -1.5 for anything else) has `least` words of each and that identity."""
    out = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            x, y = texts[i], texts[j]
            score, length, same = (np.zeros(len(y) + 1) for _ in range(3))
            best = (0.0, 0, 0)
            for v in x:
                up, ul, us = score, length, same
                match = np.concatenate([[False], y == v])
                diag = np.concatenate([[0], up[:-1]]) + np.where(match, 1.0, -1.5)
                score = np.maximum(0, np.maximum(diag, up - 1.5))
                from_diag = score == diag
                length = np.where(score == 0, 0, np.where(from_diag, np.concatenate([[0], ul[:-1]]), ul) + 1)
                same = np.where(score == 0, 0, np.where(from_diag, np.concatenate([[0], us[:-1]]) + match, us))
                k = int(score.argmax())
                if score[k] > best[0]:
                    best = (score[k], length[k], same[k])
            if best[1] >= least and best[2] >= identity * best[1]:
                out.add((i, j))
    return out


def test_recall_of_passages_against_all_pairs(spark):
    rng = random.Random(43)
    docs = [prose(rng, rng.randrange(60, 130), 3000).split(" ") for _ in range(120)]
    for k in range(45):
        plant = prose(rng, rng.randrange(54, 90), 3000).split(" ")
        for _ in range(rng.choice([2, 2, 3])):
            w = [x if rng.random() > rng.choice([0, 0.05, 0.1]) else f"e{rng.randrange(10**6)}" for x in plant]
            d = docs[rng.randrange(len(docs))]
            at = rng.randrange(len(d))
            d[at:at] = w
    number = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    want = aligned_pairs([np.array([number[w] for w in d]) for d in docs], 50, 0.8)
    rows = passages.repeats(spark, spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)).collect()
    links = {tuple(sorted((r.doc_id, o))) for r in rows for o in r.other_doc_ids}
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[top(a)] = top(b)
    # a document that shares a passage with several others is linked to one of them, and through it to the rest
    lost = sorted(p for p in want if top(p[0]) != top(p[1]))
    assert len(want) >= 45 and len(lost) <= 0.1 * len(want), f"recall {1 - len(lost) / len(want):.3f}, lost {lost}"
    touched = {i for p in want for i in p}
    assert len({i for p in links for i in p} - touched) <= 0.05 * len(touched)


def fresh(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def between(rng, *runs):
    """A text of those runs with 40 words of its own before and after each."""
    return " ".join([*fresh(rng, 40), *(w for run in runs for w in [*run, *fresh(rng, 40)])])


@pytest.mark.parametrize("seed", [0, 1, 3, 4])
def test_equal_words_are_linked_whose_seeds_have_other_centres(spark, seed):
    rng = random.Random(seed)
    run = fresh(rng, 50)
    # every seed of the run is in 24 other documents or more, none of which has 50 of its words
    docs = [between(rng, run) for _ in range(2)] + [between(rng, run[:46] if i % 2 else run[4:]) for i in range(48)]
    rows = passages.repeats(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()
    assert [({r.doc_id, *r.other_doc_ids}, [tuple(p)[:2] for p in r.passages]) for r in rows] == [({0, 1}, [(40, 90)])]


@pytest.mark.parametrize("seed", range(5))
def test_edited_words_are_linked_whose_seeds_are_in_some_other_documents(spark, seed):
    rng = random.Random(seed)
    run = fresh(rng, 60)
    edited = [f"e{rng.randrange(10**7)}" if i % 9 == 4 else w for i, w in enumerate(run)]
    docs = [between(rng, run), between(rng, edited), *(between(rng, edited[:32] if i % 2 else edited[28:]) for i in range(4))]
    rows = passages.repeats(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert [{r.doc_id, *r.other_doc_ids} for r in rows] == [{0, 1}]


@pytest.mark.parametrize("least", [20, 50])
def test_no_run_of_equal_words_is_left_out(spark, least):
    """Both documents of any run of `least` equal words have it in a passage with each other, or at one place of a third."""
    rng = random.Random(71)
    source, docs = fresh(rng, 8 * least), []
    for _ in range(150):
        at = rng.sample([rng.randrange(2 * least), rng.randrange(4 * least, 6 * least)], rng.randrange(1, 3))
        docs.append(between(rng, *(source[a : a + rng.randrange(least - 6, least + 12)] for a in at)))
    rows = passages.repeats(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5), least).collect()
    held = defaultdict(set)  # by document, the places that its words are aligned to, its own among them
    for r in rows:
        for p in r.passages:
            for i in range(p.start, p.end):
                held[r.doc_id, i].add((p.other_doc_id, p.other_start + i - p.start))
    where = defaultdict(list)
    for d, text in enumerate(docs):
        w = text.split(" ")
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].append((d, i))
    shared = [x for x in where.values() if len({d for d, _ in x}) > 1]
    assert len(shared) > 50
    for x in shared:
        for j in (0, least - 1):
            places = [{(d, i + j), *held[d, i + j]} for d, i in x]
            assert all(a & b for a in places for b in places), x


def test_a_passage_is_followed_beyond_the_margin(spark):
    rng = random.Random(47)
    run = prose(rng, 1500, 10**6).split(" ")
    x, y = " ".join([*prose(rng, 300, 10**6).split(), *run]), " ".join([*run, *prose(rng, 300, 10**6).split()])
    table = spark.createDataFrame([(0, x), (1, y)], "doc_id long, text string")
    cls = {r.doc_id: r.cls for r in passages._identities(table).collect()}
    # one short chain in the middle: its alignment reaches both ends of the run
    chain = spark.createDataFrame([(cls[0], cls[1], [1050], [750], [20], [1])], "a long, b long, xs array<int>, ys array<int>, ns array<int>, ks array<int>")
    wanted = spark.createDataFrame([(c,) for c in cls.values()], "cls long")
    row = passages._all_aligned(spark, chain, passages._word_table(spark, table, wanted), 50, 0.8).collect()
    assert [(r.start, r.end, r.other_start, r.other_end, r.matching) for r in row] == [([300], [1800], [0], [1500], [1500])]


def test_longest_common_subsequence():
    rng = random.Random(53)
    for _ in range(100):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(40))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for v in x:
            before = list(row)
            for j, w in enumerate(y, 1):
                row[j] = before[j - 1] + 1 if v == w else max(before[j], row[j - 1])
        assert passages._common(np.array(x, np.uint32), np.array(y, np.uint32)) == row[-1]


# --- SQL


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_equals_its_sql(spark, tmp_path, seed):
    from .test_simple_ops import corpus

    docs, items = corpus(random.Random(seed))
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    out = queries.op1_decontaminate(spark, str(tmp_path))
    want = con.sql(f"select {', '.join(out.columns)} from ({queries.ORACLES['op1_decontaminate']})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


# --- names that clash, rows that repeat, tables that are empty


CLASH = ["row_", "rows_", "top_", "digest_", "doc_key_", "stratum_", "copies_", "copy_", "key_", "bucket_", "text_", "id_", "of_", "odd_", "part_", "shard", "slot", "place_", "h_", "id", "gone_text_", "text_digest_0"]


def clashing(spark, rows=40):
    rng = random.Random(59)
    d = spark.createDataFrame([(i % 30, prose(rng, 30) if i % 4 else "one and the same text of some words", "en", "ab"[i % 2], 0) for i in range(rows)], DOCS)
    return d.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


@pytest.mark.parametrize("stage", ["mix", "keep_one", "decontaminate", "keep_known"])
def test_operators_leave_clashing_columns_alone(spark, stage):
    d = clashing(spark)
    if stage == "mix":
        out = mixing.mix_documents(d)
    elif stage == "keep_one":
        out = jaccard.keep_one(spark, d)
    elif stage == "decontaminate":
        out = decontaminate.decontaminate(spark, d, spark.createDataFrame([(1, "words not there")], "item_id long, text string"))
    else:
        out = langid.keep_known(spark, d, langid.train(spark, d))
    assert out.columns == d.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH)


def test_interleave_replaces_columns_of_its_own_names(spark):
    d = clashing(spark)
    out = sharding.interleave(d, 4, names=("shard", "slot", None))
    assert Counter(out.columns) == Counter(d.columns)
    rows = out.collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(10)]
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH if c not in ("shard", "slot"))


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_places_by_totals_equal_places_by_windows(spark, monkeypatch, bucket_rows):
    rng = random.Random(61)
    d = spark.createDataFrame([(i, f"t{i}", "en", rng.choice(["a", "a", "b", None, "ccc"]), 0) for i in range(400)], DOCS)
    places = lambda **k: {(r.doc_id, r.place_, r.shard_, r.slot_) for r in sharding.interleave(d, 8, bucket_rows=bucket_rows, **k).collect()}
    want = places(most_sources=1)
    assert places() == want and sorted(p for _, p, _, _ in want) == list(range(400))
    monkeypatch.setattr(sharding, "LONG", 1)  # counts too large for products in 64 bits
    assert places() == want


def test_one_row_repeated(spark):
    d = spark.createDataFrame([(7, "the same words in every row of all " * 3, "en", "a", 0)] * 300, DOCS).repartition(3)
    assert mixing.mix_documents(d).count() == 300
    assert {r.component_id for r in jaccard.join(spark, d).collect()} == {7} and jaccard.keep_one(spark, d).count() == 1
    slots = defaultdict(list)
    for r in sharding.report(d).collect():
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [37] * 4 + [38] * 4 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(langid.report(spark, d).collect()) == 300
    assert {r.score for r in ctw.report(spark, d).collect()}.__len__() == 1
    assert passages.repeats(spark, d).count() == 0  # shorter than a passage
    assert {r.n_assign for r in secrets.scan(d).collect()} == {0}


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    for out in (secrets.scan(d), langid.report(spark, d), ctw.report(spark, d), sharding.report(d), mixing.allot(d), jaccard.join(spark, d), jaccard.keep_one(spark, d), passages.repeats(spark, d)):
        assert out.count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(spark, v, v).count() == 0
    assert warc.report(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_very_long_text(spark):
    rng = random.Random(67)
    long = prose(rng, 400_000, 20_000)
    d = spark.createDataFrame([(1, long, "en", "a", 0), (2, long + " end", "en", "a", 0), (3, "x y z", "en", "b", 0)], DOCS)
    assert {r.doc_id: r.component_id for r in jaccard.join(spark, d).collect()} == {1: 1, 2: 1, 3: 3}
    rows = passages.repeats(spark, d).collect()
    assert len(rows) == 1 and rows[0].n_repeated == 400_000
    b = spark.createDataFrame([(1, " ".join(long.split(" ")[300_000:300_020]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(spark, d, b).collect()} == {1: 20, 2: 20, 3: 0}
    assert {r.n_tokens for r in ctw.report(spark, d).collect()} == {400_001, 400_002, 4}
    assert {r.lang_pred for r in langid.report(spark, d).collect()} == {"en"}
    assert zlib.crc32(long.encode()) in {r.text_crc32 for r in sharding.report(d).collect()}
