"""Sharding: the law of near-equal bytes, whole groups of equal texts, gapless slots, edge cases."""

import zlib
from collections import defaultdict

import pytest

from swathkit.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, size int"


def greedy_capacity(sizes: list[int], n: int) -> int:
    """The smallest capacity at which left-to-right filling needs at most n shards, by trying them in turn."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        fill, shards = 0, 1
        for s in sizes:
            if fill + s > capacity:
                fill, shards = 0, shards + 1
            fill += s
        if shards <= n:
            return capacity
    raise AssertionError


def test_cuts_equal_brute_force(spark):
    for sizes, n in (([5, 1, 1, 9, 2, 2, 7], 3), ([4] * 10, 4), ([1, 1, 30, 1], 2), ([3], 5)):
        atoms = spark.createDataFrame(list(enumerate(sizes)), "atom int, size long")
        cuts = sharding.minimax_cuts(atoms, n)
        capacity, fill, want = greedy_capacity(sizes, n), 0, []
        for k, s in enumerate(sizes):
            if fill + s > capacity:
                want.append(k)
                fill = 0
            fill += s
        assert cuts == want


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op1_sharding(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards, of_text, total = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r["slot"])
        of_text[raw].add(r["shard"])
        total[r["shard"]] += r["size"]
    assert set(shards) <= set(range(40)) and all(len(x) == 1 for x in of_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    largest = max(sum(r["size"] for r in rows if (texts[r["doc_id"]] or "").encode() == t) for t in of_text)
    assert max(total.values()) <= -(-sum(total.values()) // 40) + 2 * largest


@pytest.mark.parametrize("rows", [[], [(1, None, "x", 5)], [(1, "", "x", 0), (2, None, "y", 0), (2, None, "y", 0), (None, "a", None, None), (7, "é" * 50_000, "z", 1), (8, "é" * 50_000, "z", 1)]])
def test_edges(spark, rows):
    got = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    if len(rows) > 1:
        size = {r["doc_id"]: r["size"] for r in got}
        assert size[1] == size[2] == 16 and size[7] == 100_016
        assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == len({r["shard"] for r in got if r["doc_id"] in (7, 8)}) == 1
