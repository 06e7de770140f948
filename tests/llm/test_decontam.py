"""Decontamination against every window compared in turn; the FM-index against plain search."""

import random

import numpy as np

from swathkit.llm import decontam, queries


def test_index_equals_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(5):
        runs = [np.concatenate([rng.integers(1, 5, rng.integers(1, 60)), [0]]) for _ in range(8)]
        text = np.concatenate(runs).astype(np.int64)
        index = decontam.FMIndex(text, 5)
        phrases = np.unique(rng.integers(1, 5, (60, 3)), axis=0)
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_rank_equals_counting():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 11, 300)
    tree = decontam.Wavelet(values, 11)
    c, i = rng.integers(0, 11, 200), rng.integers(0, 301, 200)
    assert (tree.rank(c, i) == [(values[:k] == x).sum() for x, k in zip(c, i)]).all()


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=repr)


def test_made_up(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh"])
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([1, 4, 7, 10, 12])))) for k in range(12)] + [("e", ""), ("n", None), ("i0", "x y")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(80)))) for k in range(60)] + [(100, None), (101, ""), (102, "AB-Cd;eF\ngh " * 2000), (None, "ab cd"), (3, "ab"), (3, "ab")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(decontam.brute_force(docs, [x for x in items if x[1] is not None]), key=repr)
    assert rows_of(decontam.leak_report(docs_df, items_df)) == want
    found = decontam.find_benchmark(docs_df, items_df, block_bytes=64)  # many blocks
    assert sorted(r["doc_id"] or -1 for r in found.where("size(hit_spans) > 0").collect()) == sorted(x[0] or -1 for x in want if x[5])
    assert decontam.leak_report(docs_df, items_df.limit(0)).where("contaminated").count() == 0
    assert decontam.leak_report(docs_df.limit(0), items_df).count() == 0


def test_whole_table(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if r["text"] is not None]
    assert rows_of(queries.op5_decontamination(spark, data)) == sorted(decontam.brute_force(docs, items), key=repr)


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it, {item.title()}! After it.", 7), (2, "clean text", 8), (3, None, 9)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: (r["text"], r["n_words"]) for r in decontam.decontaminate(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert got == {1: ("Before it, ! After it.", 7), 2: ("clean text", 8), 3: (None, 9)}


def test_cut_over_several_blocks(spark):
    long = [" ".join(f"{x}{k}" for k in range(14)) for x in "abc"]
    docs = spark.createDataFrame([(k, f"start {x} end") for k, x in enumerate(long)] + [(9, None), (10, ""), (11, "left alone")], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(long)], "item_id string, text string")
    assert [last for _, last in decontam.benchmark_blocks(items, block_bytes=64)][-1] and len(list(decontam.benchmark_blocks(items, block_bytes=64))) > 1
    many, one = (decontam.find_benchmark(docs, items, block_bytes=n, cut=True) for n in (64, 1 << 20))
    assert many.columns == one.columns == ["doc_id", "text"]
    got = sorted(tuple(r) for r in many.collect())
    assert got == sorted(tuple(r) for r in one.collect())
    assert all("a0" not in (t or "") and "c13" not in (t or "") for _, t in got) and got[-1] == (11, "left alone") and got[3] == (9, None)


def test_an_item_larger_than_a_block(spark):
    rng = random.Random(8)
    huge = " ".join(f"w{rng.randrange(10**9)}" for _ in range(400))
    items = [("huge", huge), ("a", " ".join(f"a{k}" for k in range(12))), ("b", " ".join(f"b{k}" for k in range(12)))]
    words = huge.split()
    docs = [(1, "x " + " ".join(words[200:215]) + " y"), (2, " ".join(words[10:19])), (3, f"so {items[1][1]} and {items[2][1]}"), (3, "clean")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.find_benchmark(docs_df, spark.createDataFrame(items, "item_id string, text string"), block_bytes=100)
    got = sorted((r["doc_id"], [(s["start"], s["end"]) for s in r["hit_spans"]], r["hit_items"]) for r in found.collect())
    assert got == [(1, [(1, 16)], ["huge"]), (2, [], []), (3, [], []), (3, [(1, 13), (14, 26)], ["a", "b"])]
