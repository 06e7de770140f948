"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are scaled to length 1, projected at random (a fresh rotation and shift for each curve) and ordered along a
Hilbert curve through the projected space. Spark deals the rows of each curve to contiguous key ranges (blocks); a
query meets the rows of its own block and of the ``reach`` blocks on either side. What the curves find is merged and
ranked by the exact cosine in double precision.

The index is fitted on a bounded sample (``sample_rows`` vectors: centre, spread and the keys that bound the blocks),
but every vector is indexed. A block has about ``window`` of all rows, but no more than ``block_rows``; then more
blocks are within reach. The window is a share of the table because recall needs it: among vectors without structure the
nearest are hardly nearer than others, and a window of fixed size finds fewer of them the larger the table is. Of equal
vectors only the ``k + 1`` smallest ids can be among the ``k`` nearest of any query (ties go to smaller ids), so no more
are candidates; equal queries are searched once. The search runs on vectors in single precision; all that come within
``SLACK`` of the last of the best are ranked by the exact measure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CURVES = 40
DIMS = 12
BITS = 3
WINDOW = 0.005
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 4096
TIE_BITS = 24
SLACK = 1e-6


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (whole numbers under ``2 ** bits``) on the Hilbert curve (Skilling, 2004)."""
    x = cells.T.astype(np.uint64)
    dims, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.uint64), np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    x ^= flip
    keys = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = (keys << one) | ((x[i] >> np.uint64(bit)) & one)
    return keys


class Curves:
    """Projections, shifts and block bounds, fitted on a sample."""

    def __init__(self, sample: np.ndarray, rows: int, curves: int, dims: int, bits: int, window: float, block_rows: int, seed: int = 7):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        self.bits, self.dims = bits, min(dims, width)
        self.centre = sample.mean(0)
        size = min(block_rows, max(64, math.ceil(window * rows)))
        blocks = max(1, min(math.ceil(rows / size), len(sample) // 8 or 1))
        self.reach = max(1, math.ceil(window * blocks))
        self.axes, self.shift, self.bounds = [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.dims]
            y = (sample - self.centre) @ axes
            spread = y.std(0)
            self.axes.append(axes / np.where(spread > 0, spread, 1))
            self.shift.append(rng.uniform(-0.3, 0.3, self.dims))
            keys = np.sort(self.keys(sample, len(self.axes) - 1) << np.uint64(TIE_BITS))
            self.bounds.append(np.unique(keys[np.arange(1, blocks) * len(keys) // blocks]) if blocks > 1 else keys[:0])

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        y = (unit - self.centre) @ self.axes[curve] + self.shift[curve]
        return hilbert_keys((np.clip((y + 2.2) / 4.4, 0, 0.999999) * (1 << self.bits)).astype(np.int64), self.bits)

    def blocks(self, unit: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """The block of each vector; rows of equal keys are told apart by a hash of their ids."""
        tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
        return np.searchsorted(self.bounds[curve], (self.keys(unit, curve) << np.uint64(TIE_BITS)) | tie, side="right")


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector is neither null nor zero and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(fine)


def scaled(vector: str):
    """A vector over the power of two below its largest component: exact, and its squares neither overflow nor vanish."""
    return F.expr(f"element_at(transform(array(pow(2D, floor(log2(array_max(transform({vector}, x -> abs(x))))))), m -> transform({vector}, x -> x / m)), 1)")


def units(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of length 1; of each the first ``width`` components, with zeros for those it lacks."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        v = np.asarray(v, dtype=np.float64)
        v = v / np.abs(v).max()
        out[k, : len(v)] = (v / np.linalg.norm(v))[:width]
    return out


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: float = WINDOW, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each query row, without the row itself.

    ``is_query`` is a condition on ``vec_id``. Rows without a usable vector take no part; every other row is searched. A
    vector shorter than another counts as padded with zeros. Rows of one id and vector count once; an id with several
    vectors is as near as the nearest of them. Fewer candidates than ``k`` give fewer rows; an empty table gives none;
    other columns are ignored.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid_vectors(df, id_col, vector_col).distinct()
    rows = common.materialize(rows.withColumn("same", F.xxhash64("vector")))
    commonest = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if commonest is None:
        return spark.createDataFrame([], schema)
    width, n = commonest["width"], rows.count()  # curves are laid through the commonest width
    sample = pd.Series([r["vector"] for r in rows.select("vector").sample(min(1.0, sample_rows / n), seed=11).limit(2 * sample_rows).collect()] or [rows.first()["vector"]])
    fitted = Curves(units(sample, width), n, curves, dims, bits, window, block_rows)

    first = Window.partitionBy("same", "vector").orderBy("vec_id")
    candidates = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    asked = rows.where(is_query).select("same", "vector", F.col("vec_id").alias("query_id"))
    classes = asked.groupBy("same", "vector").agg(F.min("query_id").alias("class_id"))

    def dealt(queries: bool):
        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if not len(pdf):
                    continue
                unit, ids = units(pdf["vector"], width), pdf["id"].to_numpy()
                packed = [v.tobytes() for v in unit.astype(np.float32)]
                for c in range(len(fitted.axes)):
                    at = fitted.blocks(unit, ids, c)
                    for step in range(-fitted.reach, fitted.reach + 1) if queries else (0,):
                        to = at + step
                        inside = (to >= 0) & (to <= len(fitted.bounds[c]))
                        where = np.flatnonzero(inside)
                        if len(where):
                            yield pd.DataFrame({"curve": c, "block": to[where], "id": ids[where], "asks": queries, "packed": [packed[i] for i in where]})

        return deal

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        empty = pd.DataFrame({"class_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.float64)})
        if not asks.any() or asks.all():
            return empty
        ids = pdf["id"].to_numpy()
        unit = np.frombuffer(b"".join(pdf["packed"]), np.float32).reshape(len(pdf), -1)
        order = np.argsort(ids[~asks], kind="stable")
        c_ids, c_unit = ids[~asks][order], unit[~asks][order]
        q_ids, q_unit = ids[asks], unit[asks]
        out = []
        for start in range(0, len(q_ids), 512):
            scores = q_unit[start : start + 512] @ c_unit.T
            top = min(k + 1, scores.shape[1])
            # a score's last places may vary: all that come near the last of the best are kept for the exact ranking
            least = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
            q, c = np.nonzero(scores >= least[:, None] - SLACK)
            out.append(pd.DataFrame({"class_id": q_ids[start + q], "vec_id": c_ids[c], "score": scores[q, c].astype(np.float64)}))
        return pd.concat(out) if out else empty

    wide = "curve int, block long, id long, asks boolean, packed binary"
    both = candidates.select(F.col("vec_id").alias("id"), "vector").mapInPandas(dealt(False), wide).unionByName(classes.select(F.col("class_id").alias("id"), "vector").mapInPandas(dealt(True), wide))
    found = both.groupBy("curve", "block").applyInPandas(meet, "class_id long, vec_id long, score double")
    found = found.groupBy("class_id", "vec_id").agg(F.max("score").alias("near"))
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("near"), "vec_id"))
    found = found.withColumn("nth", nth).withColumn("last", F.min(F.when(F.col("nth") <= k + 1, F.col("near"))).over(Window.partitionBy("class_id"))).where(F.col("near") >= F.col("last") - SLACK)
    # The exact measure on the original vectors, then the answers of each class for every query in it.
    q = classes.select("class_id", F.col("vector").alias("a"), "same")
    exact = found.select("class_id", "vec_id").join(rows.select("vec_id", F.col("vector").alias("b")), "vec_id").join(q, "class_id").select("same", "a", "vec_id", scaled("a").alias("x"), scaled("b").alias("y"))
    zero = lambda u: F.coalesce(u, F.lit(0.0))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: zero(u) * zero(v)), F.lit(0.0), lambda s, t: s + t)
    score = dot(F.col("x"), F.col("y")) / (F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y"))))
    exact = exact.select("same", F.col("a").alias("vector"), "vec_id", score.alias("score"))
    answers = asked.join(exact, ["same", "vector"]).where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
