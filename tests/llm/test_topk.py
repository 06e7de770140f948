"""Exact top-k: every answer against all pairs, with lengths that prune, ties, copies, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.llm import queries, topk


def brute(rows, asks, k, scale=1024):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            fine.setdefault(i, []).append([math.floor(scale * x) for x in v])
    out = {}
    for q in filter(asks, fine):
        score = {i: max(sum(a * b for a, b in zip(x, y)) for x in fine[q] for y in ys) for i, ys in fine.items() if i != q}
        out[q] = [(max(-(2**63), min(2**63 - 1, s)), i) for i, s in sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]]
    return {q: found for q, found in out.items() if found}


def answers(df, **how):
    out = {}
    for r in topk.top_products(df, F.col("vec_id") % how.pop("every", 10) == 0, **how).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


@pytest.mark.parametrize("kind", ["plain", "lengths", "low rank", "copies", "few"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000 if kind != "few" else 4, 12))
    if kind == "lengths":
        x *= rng.pareto(1.2, size=(len(x), 1)) + 0.01
    elif kind == "low rank":
        x = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 12)) + 0.01 * x
    elif kind == "copies":
        x[500:2000] = x[7]
        x[2000:2400] = np.round(x[2000:2400])
    rows = [(k, [float(v) for v in x[k]]) for k in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert answers(df, k=5, every=50, block_rows=300, chunk_queries=20, head_rows=64) == brute(rows, lambda i: i % 50 == 0, 5)


def test_odd_vectors(spark):
    rows = [
        (0, [1.5, -2.5, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf")]), (5, [0.0, 0.0]), (6, []), (10, [3.0]), (11, [1.0, 1.0, 1.0, 7.0]), (12, [1e300, 1.0]),
        (13, [-1e300, 1.0]), (14, [1e18, -1e18]), (20, [1e300, 1e300]), (0, [1.5, -2.5, 0.0]), (0, [9.0, 9.0]), (11, [2.0, 0.0]), (None, [5.0, 5.0]), (15, [-0.0004]), (30, [1.7e308]), (40, [123456789.25, 98765432.5]),
        (41, [987654321.125, -123456789.5]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got, want = answers(df, k=6), brute(rows, lambda i: i % 10 == 0, 6)
    assert got == want
    assert answers(df.where("vec_id > 100"), k=3) == {} and answers(df.where("vec_id = 0"), k=3) == {}


def test_prunes_by_length():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * rng.normal(size=(5000, 16)) * (rng.pareto(1.0, size=(5000, 1)) + 0.01))
    lengths = np.linalg.norm(x, axis=1)
    packed, ids = [v.tobytes() for v in x], np.arange(5000)
    block = topk.Block(ids, packed, lengths, topk.rotation(x[:500]))
    best = topk.Best(2, 10, [None, None])
    seen = []
    add = best.add
    best.add = lambda q, i, s: (seen.append(len(q)), add(q, i, s))
    block.search(ids[:2], packed[:2], lengths[:2], best)
    assert sum(seen) < 2 * 5000 * 0.6
    for q in range(2):
        score = (x @ x[q]).astype(np.int64)
        assert [i for _, i in best.rows[q]] == [i for i in np.lexsort((ids, -score)) if i != q][:10]


def test_query_equals_sql(spark, data, duck, same_rows):
    got, want = queries.op13_exact_topk(spark, data), duck.execute(queries.ORACLE_SQL["op13_exact_topk"])
    assert same_rows(got.columns, [tuple(r) for r in got.collect()]) == same_rows([d[0] for d in want.description], want.fetchall())
