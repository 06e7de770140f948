"""The n-gram join against all pairs compared in turn, large buckets, copies and edge cases."""

import random

import numpy as np
import pytest

from swathkit.llm import ngram_join, queries


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    """doc_id -> the smallest id of all that similarities of at least 0.8 connect."""
    sets = {i: grams(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def made_up(seed, near=40):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    base = [word() for _ in range(120)]
    rows = [(k, " ".join(word() for _ in range(60))) for k in range(60)]
    for k in range(near):  # a large group of near copies, each another word or two away from the first
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(120)] = word()
        rows.append((1000 + k, " ".join(own)))
    return rows + [(200 + k, rows[3][1]) for k in range(30)] + [(300, None), (301, ""), (302, " \n "), (303, "a b"), (304, "A  b"), (305, "a b c")]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made_up(seed)
        got = ngram_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string"))
        classes = {r["doc_id"]: r["class_id"] for r in got[2].collect()}
        assert classes == brute_classes(rows)
        texts = dict(rows)
        for r in got[1].collect():
            x, y = grams(texts[r["a"]]), grams(texts[r["b"]])
            assert r["a"] < r["b"] and abs(r["similarity"] - len(x & y) / len(x | y)) < 1e-9 and r["similarity"] >= 0.8


def test_whole_table(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op10_ngram_join(spark, data).collect()}
    assert got == brute_classes(rows)


def test_keep_one_and_edges(spark):
    rows = [(5, "one two three four five six", 1), (4, "One two  three four five six", 2), (9, None, 3), (8, None, 4), (None, "one two three four five six", 5), (7, "", 6), (7, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    kept = sorted((tuple(r) for r in ngram_join.keep_one(df).collect()), key=str)
    assert kept == sorted([r for r in rows if r[0] != 5], key=str)
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_bands():
    bands, rows = ngram_join.choose_bands()
    assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.9):  # one band of one row agrees as often as the sets are similar
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        cut = int(2000 * share)
        rest = (2000 - cut) // 2
        x, y = np.unique(both[: cut + rest]), np.unique(np.concatenate([both[:cut], both[cut + rest :]]))
        keys = ngram_join.band_keys([x, y], 1000, 1)
        assert abs((keys[0] == keys[1]).mean() - share) < 0.06


def test_long_text(spark):
    text = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in ngram_join.join_similar(df)[2].collect()} == {1: 1, 2: 1, 3: 3}


def test_links_of_large_groups(spark, monkeypatch):
    """n_links and the links equal brute force in groups of more than 12 near copies, in one block and in several."""
    check_links(spark, monkeypatch, made_up(3, near=70))


@pytest.mark.parametrize("near", [12, 13, 14, 200])
def test_links_of_near_copies(spark, monkeypatch, near):
    """Near copies, each with up to two other words than the first; beyond a block, rings near the centre aren't compared."""
    check_links(spark, monkeypatch, made_up(near, near=near), blocks=(1024, 16) if near == 200 else (1024,))


def check_links(spark, monkeypatch, rows, blocks=(1024, 16)):
    sets = {i: grams(t) for i, t in rows}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(frozenset(sets[i]), i)
    ids = sorted(i for g, i in reps.items() if g)
    links = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    degree = {i: sum(i in pair for pair in links) for i in ids}
    copies = {i: sum(sets[k] == sets[i] for k in sets) for i in ids}
    want = {i: degree[reps[frozenset(g)]] + copies[reps[frozenset(g)]] - 1 if g else 0 for i, g in sets.items()}
    assert max(degree.values()) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in blocks:
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block, raising=False)
        _, found, classes = ngram_join.join_similar(df)
        assert {r["doc_id"]: r["n_links"] for r in classes.collect()} == want
        assert {(r["a"], r["b"]) for r in found.collect()} == links and found.count() == len(links)


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 100, dtype=np.uint64)) for _ in range(60)] + [np.unique(rng.integers(0, 9000, 100, dtype=np.uint64)) for _ in range(20)]
    got = ngram_join.shared_counts(sets[:50], sets[50:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[50:]] for x in sets[:50]]).all()


def test_packing_and_repeated_ids(spark):
    grams = ngram_join.shingles("a b c d e f g h")
    import pyarrow as pa

    assert (ngram_join.unpacked(pa.scalar(ngram_join.packed(grams), pa.binary())) == grams).all()
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (2, text), (2, "quite another text of the same id, which stays"), (3, text + " x"), (3, text + " x")]
    kept = sorted(tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[0] == rows[0] and all(r in (rows[0], rows[1], rows[2]) for r in kept) and rows[2] in kept
