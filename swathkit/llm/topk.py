"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds on the rest.

Vectors are made whole numbers (``floor(scale * x)``), so a score is an exact integer. All vectors are sorted by length and
cut into blocks; queries learn a first threshold, their k-th best score, among the longest vectors of all. A
query is sent to a block only if its own length times that of the block's longest vector reaches the threshold. There, strips
of descending length are tried until that product fails; of each strip the first coordinates after a rotation are multiplied,
the product of the lengths of what is left bounds the rest, and pairs whose bound falls below the threshold go, in ``STAGES``
steps. What stays is scored exactly on the original whole numbers and raises the threshold.

The rotation (right singular vectors of at most ``SAMPLE_BYTES`` of vectors) concentrates lengths in the first coordinates;
whatever it is, bounds hold, for it is orthogonal. Nothing is approximate and nothing is capped: vectors of equal length or equal
vectors only fill more blocks.

Memory: a task holds one block (its vectors and their rotation) and one Arrow batch of queries. Queries come in chunks of about
``chunk_queries``, which set how often vectors are sent. Broadcast: the rotation and the head, bounded by bytes, and one number
for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking
from . import common

SCALE = 1024
MOST_BLOCK_ROWS = 65_536
BLOCK_BYTES = 64 << 20
CHUNK_QUERIES = 65_536
STRIP_ROWS = 2048
TOGETHER = 256
HEAD_ROWS = 2048
SAMPLE_BYTES = 8 << 20
STAGES = (0.25, 0.5)
EXACT = 2.0**53
_LONG = 2**63 - 1


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, packed (doubles, each a whole number) and length of the rows that have an id and a usable vector: not null, all
    components finite, also after scaling. Ids are whole numbers (a text that is none is an error); an empty vector has length 0."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, vectors, rows = batch.column(0), batch.column(1), []
            for k in range(len(batch)):
                v = vectors[k].values
                if v.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.to_numpy(zero_copy_only=False) * float(scale))
                    if not np.isfinite(x).all():
                        continue
                    most = float(np.abs(x).max(initial=0.0))
                    length = most * float(np.linalg.norm(x / most)) if most else 0.0  # squares of the largest overflow
                rows.append((ids[k].as_py(), x.tobytes(), min(length, 1.7e308)))
            told = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(told[0], pa.int64()), pa.array(told[1], pa.binary()), pa.array(told[2], pa.float64())], names=["vec_id", "packed", "length"])

    fine = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return fine.mapInArrow(pack, "vec_id long, packed binary, length double")


def matrix(packed, width: int | None = None) -> np.ndarray:
    """Packed vectors as rows, padded with zeros or cut to a width."""
    rows = [np.frombuffer(x, np.float64) for x in packed]
    width = max((len(x) for x in rows), default=0) if width is None else width
    if all(len(x) == width for x in rows):
        return np.concatenate(rows).reshape(len(rows), width) if rows else np.zeros((0, width))
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x[:width]
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, pair by pair: in doubles where these are exact, else in Python's integers."""
    most = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v) if x and y) for u, v in zip(a, b)], dtype=object)


def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(u, v) if x and y) for v in b] for u in a], dtype=object).reshape(len(a), len(b))


def rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose first columns hold most of the sample's squared lengths: its right singular vectors."""
    most = np.abs(sample).max(initial=0.0)
    return np.linalg.svd(sample / most if most else sample, full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])


def _double(threshold: int | None) -> float:
    """A threshold as a double; without one, or beyond that range, one that prunes nothing."""
    return float(threshold) if threshold is not None and abs(threshold) < 10**300 else -np.inf


class Best:
    """The k best (score, id) of some queries: highest score, then smallest id, no id twice."""

    def __init__(self, queries: int, k: int, floor: list[int | None]):
        self.k, self.floor = k, floor
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def threshold(self, q: int) -> int | None:
        own = -self.rows[q][-1][0] if len(self.rows[q]) == self.k else None
        return max((x for x in (own, self.floor[q]) if x is not None), default=None)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes found pairs; of each query at most k need be looked at, after a sort."""
        order = np.lexsort((ids, -scores, q)) if scores.dtype != object else sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i]))
        q, ids, scores = q[order], ids[order], scores[order]
        cuts = np.flatnonzero(np.diff(q)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(q)]):
            if hi > lo:
                held = dict.fromkeys(self.rows[q[lo]])
                seen, taken = {i for _, i in held}, 0
                fresh = []
                for s, i in zip(scores[lo:hi].tolist(), ids[lo:hi].tolist()):  # ascending by (-score, id): k different ids are enough
                    if taken == self.k:
                        break
                    fresh.append((-s, i))
                    taken += i not in seen
                    seen.add(i)
                best: dict[int, int] = {}
                for s, i in sorted([*held, *fresh]):
                    best.setdefault(i, s)
                self.rows[q[lo]] = [(s, i) for i, s in list(best.items())[: self.k]]


class Block:
    """Vectors of one block, longest first, with their rotation and the lengths of what each stage leaves out."""

    def __init__(self, ids: np.ndarray, packed: list[bytes], lengths: np.ndarray, turn: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.lengths, self.turn = ids[order], lengths[order], turn
        packed = [packed[k] for k in order]
        widths = np.array([len(x) // 8 for x in packed])
        self.strips = []
        for at in range(0, len(packed), STRIP_ROWS):
            for width in np.unique(widths[at : at + STRIP_ROWS]):
                rows = at + np.flatnonzero(widths[at : at + STRIP_ROWS] == width)
                whole = matrix([packed[k] for k in rows], int(width))
                self.strips.append((rows, whole, *turned(whole, self.lengths[rows], turn)))

    def search(self, ids: np.ndarray, packed: list[bytes], lengths: np.ndarray, best: Best) -> None:
        """All vectors that may be among the best of each query, its own row left out, are scored and added."""
        widest = matrix(packed)
        parts, rests = turned(widest, lengths, self.turn)
        with np.errstate(over="ignore", invalid="ignore"):
            for rows, whole, v_parts, v_rests in self.strips:
                least = np.array([_double(t) for t in map(best.threshold, range(len(ids)))])
                slack = 1e-9 * lengths * self.lengths[rows[0]] + 1e-9
                open_ = np.flatnonzero(~(lengths * self.lengths[rows[0]] + slack < least))
                if not len(open_):
                    continue
                partial = np.zeros((len(open_), len(rows)))
                alive = np.ones((len(open_), len(rows)), bool)
                for part, v_part, rest, v_rest in zip(parts, v_parts, rests, v_rests):
                    partial += part[open_] @ v_part.T
                    # what isn't a number (sums beyond a double's range) stays
                    alive &= ~(partial + rest[open_, None] * v_rest[None, :] + slack[open_, None] < least[open_, None])
                    if not alive.any():
                        break
                alive &= ids[open_, None] != self.ids[rows][None, :]
                width = whole.shape[1]
                asked = widest[open_, :width] if widest.shape[1] >= width else np.pad(widest[open_], ((0, 0), (0, width - widest.shape[1])))
                if alive.mean() > 0.05:
                    scores = outer(asked, whole)
                    q, v = np.nonzero(alive & (scores >= least[open_, None] - slack[open_, None]))
                    best.add(open_[q], self.ids[rows[v]], scores[q, v])
                else:
                    q, v = np.nonzero(alive)
                    for at in range(0, len(q), 65536):
                        a, b = q[at : at + 65536], v[at : at + 65536]
                        best.add(open_[a], self.ids[rows[b]], inner(asked[a], whole[b]))


def turned(whole: np.ndarray, lengths: np.ndarray, turn: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Coordinates of each stage after rotation, and the length of all that is left after it (never too short)."""
    width = len(turn)
    y = (whole[:, :width] if whole.shape[1] >= width else np.pad(whole, ((0, 0), (0, width - whole.shape[1])))) @ turn
    ends = [0, *(max(1, round(width * s)) for s in STAGES)] if width else [0]
    parts, rests = [y[:, a:b] for a, b in zip(ends, ends[1:])], []
    unit = np.where(lengths > 0, lengths, 1.0)
    scaled = y / unit[:, None]
    for b in ends[1:]:
        taken = (scaled[:, :b] ** 2).sum(1)
        rests.append(unit * np.sqrt(np.clip(1.0 - taken, 0.0, None) + 1e-12))
    return parts, rests


_TURNED = str.maketrans("0123456789", "9876543210")


def sortable(score: int) -> str:
    """A whole number of any size as a string; strings sort as the numbers do."""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return "+" + key if score >= 0 else "!" + key.translate(_TURNED)


def _answers(ids: np.ndarray, best: Best) -> pd.DataFrame:
    rows = [(int(ids[q]), i, sortable(-s), max(-_LONG - 1, min(_LONG, -s))) for q, found in enumerate(best.rows) for s, i in found]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "key", "score"])


def top_products(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = SCALE, block_rows: int | None = None, chunk_queries: int = CHUNK_QUERIES, head_rows: int = HEAD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest inner products of each query row with all others, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. Rows without an id or a usable vector (see ``whole_numbers``) take no part. A
    vector shorter than another counts as padded with zeros; zero vectors score 0. Repeated rows count once; an id with
    several vectors has the highest of its products. Fewer candidates than ``k`` give fewer rows; an empty table or one
    without a query gives none; other columns are ignored. Scores of any size are ranked exactly; one beyond a long is
    told as the largest or smallest long. ``block_rows`` is a 64th of the rows by default, at least 1,024 and no more
    than memory allows (``MOST_BLOCK_ROWS``, ``BLOCK_BYTES``); it changes no result.
    """
    spark = df.sparkSession
    vectors = common.materialize(whole_numbers(df, id_col, vector_col, scale))
    rows, widest = vectors.agg(F.count(F.lit(1)), F.max(F.octet_length("packed"))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_row = max(8, widest)
    block_rows = block_rows or min(MOST_BLOCK_ROWS, max(1024, -(-rows // 64)), max(64, BLOCK_BYTES // per_row))
    placed = ranking.numbered(vectors, [F.desc("length"), "vec_id"], "place", common.materialize)
    placed = placed.withColumn("block", F.expr(f"CAST((place - 1) DIV {block_rows} AS INT)"))
    fit = max(1, min(head_rows, SAMPLE_BYTES // per_row))
    head = placed.where(F.col("place") <= fit).select("vec_id", "packed", "length").collect()  # bounded in rows and bytes
    longest = [r["longest"] for r in placed.groupBy("block").agg(F.max("length").alias("longest")).orderBy("block").collect()]  # a number a block
    asked = vectors.where(is_query)
    usual = vectors.groupBy(F.octet_length("packed").alias("width")).count().orderBy(F.desc("count"), "width").first()["width"] // 8
    chosen = vectors.select("packed").sample(min(1.0, 2.0 * fit / rows), seed=13).limit(fit).collect()
    turn = rotation(matrix([r["packed"] for r in chosen], usual))
    shipped = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in head], np.int64), [bytes(r["packed"]) for r in head], np.array([r["length"] for r in head]), turn, np.array(longest)))

    def seed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds to each query its threshold, the k-th best score among the longest vectors (null: fewer than k), and the number of blocks within reach."""
        block = Block(*shipped.value[:4])
        for pdf in it:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                best = Best(len(part), k, [None] * len(part))
                block.search(part["vec_id"].to_numpy(), list(part["packed"]), part["length"].to_numpy(), best)
                least = list(map(best.threshold, range(len(part))))
                with np.errstate(over="ignore"):
                    reach = [int(np.count_nonzero(~(own * shipped.value[4] * (1 + 1e-9) + 1e-6 < _double(t)))) for own, t in zip(part["length"], least)]
                yield part.assign(least=[None if t is None else str(t) for t in least], reach=reach)

    seeded = common.materialize(asked.mapInPandas(seed, "vec_id long, packed binary, length double, least string, reach int"))
    chunks = max(1, -(-seeded.count() // chunk_queries))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    sent = seeded.where("reach > 0").select(F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("asks"), "vec_id", "packed", "length", "least")
    held = placed.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("asks"), "vec_id", "packed", "length", F.lit(None).cast("string").alias("least"))

    def meet(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted: the vectors of a block, then its queries; the block is built at its first query."""
        at, waiting, block = None, [], None
        for pdf in it:
            for key, rows in pdf.groupby(["block", "chunk"], sort=True):
                if key != at:
                    at, waiting, block = key, [], None
                vectors, queries = rows[rows["asks"] == 0], rows[rows["asks"] == 1]
                if len(vectors):
                    waiting.append(vectors[["vec_id", "packed", "length"]])
                if len(queries) and waiting:
                    all_ = pd.concat(waiting)
                    block, waiting = Block(all_["vec_id"].to_numpy(), list(all_["packed"]), all_["length"].to_numpy(), shipped.value[3]), []
                for start in range(0, len(queries), TOGETHER):
                    part = queries.iloc[start : start + TOGETHER]
                    best = Best(len(part), k, [None if x is None else int(x) for x in part["least"]])
                    block.search(part["vec_id"].to_numpy(), list(part["packed"]), part["length"].to_numpy(), best)
                    yield _answers(part["vec_id"].to_numpy(), best)
        common.give_back()

    met = held.unionByName(sent).repartition(common.partitions(spark), "block", "chunk").sortWithinPartitions("block", "chunk", "asks")
    found = met.mapInPandas(meet, "query_id long, vec_id long, key string, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("key", "score")).alias("best"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best.key"), "vec_id"))
    best = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("best.score").alias("score"))
