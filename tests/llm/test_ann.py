"""Nearest neighbours: recall against brute force, exact scores and ranks, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.llm import ann, queries


def brute(rows, asked, k=5):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = np.round(unit @ unit[np.searchsorted(ids, q)], 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def test_hilbert_order_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall_on_the_table(spark, data):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r["embedding"] is not None}
    got = queries.op2_nearest_neighbours(spark, data).collect()
    want = brute(rows, [i for i in rows if i % 50 == 0])
    found = {q: [] for q in want}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        a, b = np.array(rows[r["query_id"]], np.float64), np.array(rows[r["vec_id"]], np.float64)
        assert math.isclose(r["score"], a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs_tol=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    assert all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["clustered", "copies"])
def test_hard_shapes(spark, kind):
    rng = np.random.default_rng(6)
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(20, 24)), 60, axis=0) + 0.3 * rng.normal(size=(1200, 24))
    else:
        x = rng.normal(size=(1200, 24))
        x[:500] = x[0]  # one vector holds a large share of all rows
    rows = {k: [float(v) for v in x[k]] for k in range(1200)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, range(0, 1200, 50))
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    if kind == "copies":
        assert found[0] == [1, 2, 3, 4, 5] and found[50] == [0, 1, 2, 3, 4]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [nan, 1.0], "a"), (6, [inf, 1.0], "a"), (7, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (2, [0.0, 1.0], "a"), (8, [1.0, 2.0, 3.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 0.267261242), (0, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = df.where("vec_id = 0")
    assert ann.nearest(one, F.col("vec_id") % 50 == 0).count() == 0


def test_extreme_vectors_widths_and_repeated_ids(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [1.0]), (5, [-1.0, -1.0]), (5, [3.0, 4.0]), (6, [1.7e308, 1.7e308, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, F.col("vec_id") == 0, k=9).orderBy("rank").collect()]
    assert got == [(2, 1.0), (5, 0.989949), (6, 0.816497), (1, 0.707107), (3, 0.707107), (4, 0.707107)]


def test_hot_group_of_scaled_copies(spark):
    """A third of all rows are one vector, scaled: their cosines differ in last places only, and the largest win."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0] * rng.uniform(0.5, 2, (300, 1)) * (1 + 1e-7 * rng.normal(size=(300, 16)))
    rows = {k: [float(v) for v in x[k]] for k in range(900)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {r["rank"]: r["score"] for r in ann.nearest(df, F.col("vec_id") == 50).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sort(np.delete(unit @ unit[50], 50))[::-1][:5]
    assert np.allclose([got[k] for k in range(1, 6)], want, atol=1e-15, rtol=0)
