"""Rasters as blocks: a row for each square of cells, its values along rows in one array.

Windows are cut out of blocks by slices and put together from the few blocks they lie on; models get whole batches of windows,
and what they say of overlapping windows is summed up block by block. No row holds a single cell on the way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import Scorer

BLOCK = 256


def to_blocks(cells: DataFrame, row: str, col: str, value: str, size: int = BLOCK, keys: list[str] | None = None) -> DataFrame:
    """keys, br, bc, data (array<double>, null where there is no cell or value) of the squares of ``size`` cells that hold any cell; of repeated cells one counts."""
    keys = keys or []
    at = F.pmod(F.col(row), F.lit(size)) * size + F.pmod(F.col(col), F.lit(size))
    place = lambda c: F.floor(F.col(c) / size).cast("int")
    rows = cells.select(*keys, place(row).alias("br"), place(col).alias("bc"), at.cast("int").alias("at"), F.col(value).cast("double").alias("v"))
    kinds = dict(rows.dtypes)
    names = [*keys, "br", "bc"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known = table.filter(table.column("v").is_valid())
        data, missing = np.zeros(size * size), np.ones(size * size, bool)
        where = known.column("at").to_numpy()
        data[where], missing[where] = known.column("v").to_numpy(), False
        whole = pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(data, mask=missing))
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), whole], names=[*names, "data"])

    return rows.groupBy(*names).applyInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "data array<double>"]))


def to_cells(blocks: DataFrame, size: int, row: str, col: str, value: str, data: str = "data") -> DataFrame:
    """The cells of blocks: the other columns but br and bc, row, col, value."""
    others = [c for c in blocks.columns if c not in ("br", "bc", data)]
    told = blocks.select(*others, "br", "bc", F.posexplode(data).alias("_at", value))
    return told.select(*others, (F.col("br") * size + F.expr(f"CAST(_at DIV {size} AS INT)")).alias(row), (F.col("bc") * size + F.col("_at") % size).alias(col), value)


def cut(blocks: DataFrame, windows: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """``windows`` (keys, r0, c0, height, width and columns that tell them apart) with data: their cells along rows, null beyond the raster.

    A window meets the blocks it lies on in an equi-join; of each only the rows and columns inside are taken on, so what
    is shuffled grows with the windows and not with the blocks. All columns of ``windows`` must be comparable.
    """
    keys = keys or []
    span = lambda at, n: F.explode(F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + F.col(n) - 1) / size)).cast("array<int>"))
    met = windows.select("*", span("r0", "height").alias("br")).select("*", span("c0", "width").alias("bc")).join(blocks.select(*keys, "br", "bc", "data"), [*keys, "br", "bc"], "left")
    first = lambda at, b: F.greatest(F.col(at), F.col(b) * size)
    count = lambda at, n, b: F.least(F.col(at) + F.col(n), (F.col(b) + 1) * size) - first(at, b)
    met = met.withColumns({"_i": first("r0", "br"), "_j": first("c0", "bc"), "_h": count("r0", "height", "br"), "_w": count("c0", "width", "bc")})
    start = (F.col("_i") - F.col("br") * size) * size + F.col("_j") - F.col("bc") * size + 1
    none = F.array_repeat(F.lit(None).cast("double"), F.col("_w").cast("int"))
    lines = F.transform(F.sequence(F.lit(0), F.col("_h").cast("int") - 1), lambda k: F.coalesce(F.slice("data", (start + k * size).cast("int"), F.col("_w").cast("int")), none))
    pieces = met.groupBy(*windows.columns).agg(F.array_sort(F.collect_list(F.struct("br", "bc", (F.col("_i") - F.col("r0")).cast("int").alias("i"), lines.alias("lines")))).alias("_pieces"))
    inside = lambda i: F.filter("_pieces", lambda p: (p["i"] <= i) & (i < p["i"] + F.size(p["lines"])))
    line = lambda i: F.flatten(F.transform(inside(i), lambda p: F.get(p["lines"], i - p["i"])))
    return pieces.withColumn("data", F.flatten(F.transform(F.sequence(F.lit(0), F.col("height").cast("int") - 1), line))).drop("_pieces")


def resampled(data: Column | str, n: int, m: int) -> Column:
    """A square of ``n`` cells a side on ``m`` cells a side, bilinear between centres; null cells count for nothing and the other weights are scaled up."""
    data = F.col(data) if isinstance(data, str) else data
    axis = []
    for t in range(m):
        at = (t + 0.5) * n / m - 0.5
        low = math.floor(at)
        axis.append([(i, w) for i, w in ((low, 1 - (at - low)), (low + 1, at - low)) if 0 <= i < n and w > 0])
    told = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in parts]) for parts in axis])

    def cell(t: Column) -> Column:
        own = lambda k: F.get(told, k.cast("int"))
        four = F.flatten(F.transform(own(F.floor(t / m)), lambda y: F.transform(own(t % m), lambda x: F.struct((y["w"] * x["w"]).alias("w"), F.get(data, y["i"] * n + x["i"]).alias("v")))))
        known = F.filter(four, lambda e: e["v"].isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, e: s + e["w"] * e["v"]) / F.aggregate(known, F.lit(0.0), lambda s, e: s + e["w"]))

    return F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), cell)


def crop_or_pad(data: Column | str, height: int, width: int, target: int, stride: int | None = None) -> Column:
    """The middle of a raster of ``height`` x ``width`` cells on ``target`` x ``target``, with zeros around it where it is smaller, and for nulls. A row of ``data`` has ``stride`` cells (``width``, if not given)."""
    data = F.col(data) if isinstance(data, str) else data
    dr, dc = math.floor((height - target) / 2), math.floor((width - target) / 2)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    left, first = max(0, -dc), max(0, dc)
    count = min(width - first, target - left)
    lines = []
    for i in range(dr, dr + target):
        inside = 0 <= i < height
        lines.append(F.concat(zeros(left), F.slice(data, i * (stride or width) + first + 1, count), zeros(target - left - count)) if inside else zeros(target))
    return F.transform(F.flatten(F.array(*lines)), lambda v: F.coalesce(v, F.lit(0.0)))


def hann(n: int, least: float = 1e-6) -> np.ndarray:
    """The product of two Hann curves, held above ``least`` after multiplying."""
    curve = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    return np.maximum(np.outer(curve, curve), least)


def blend_windows(windows: DataFrame, make: Callable[[], Scorer], patch: int, size: int, batch: int = 16, missing: float | None = None) -> DataFrame:
    """br, bc, code, score (arrays along rows): the class of each cell of the blocks that windows lie on.

    ``windows`` has r0, c0 and data of ``patch`` x ``patch`` cells (null counts as 0). The model is asked once for each
    ``batch`` of windows and gives scores (windows, classes, cells); their softmax is weighted by Hann curves, summed up over
    all windows of a cell, and the best class wins (ties: the lowest). Cells under no window have code -1 and score 0. A
    block meets the windows that overlap it, of which there are as many as the step between windows allows. With ``missing``, that
    stands in for null when the model is asked, and null cells have code -1 and score 0, too.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weight = make(), hann(patch)
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                asked = np.stack([np.asarray(x, dtype=np.float64) for x in part["data"]])
                p = model.predict(np.nan_to_num(asked, nan=0.0 if missing is None else missing))
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                if missing is not None:
                    p = np.where(np.isnan(asked)[:, None, :], 0.0, p)
                p = p.reshape(len(part), p.shape[1], patch, patch) * weight
                rows = []
                for own, r0, c0 in zip(p, part["r0"], part["c0"]):
                    for br in range(r0 // size, (r0 + patch - 1) // size + 1):
                        for bc in range(c0 // size, (c0 + patch - 1) // size + 1):
                            i0, i1 = max(r0, br * size), min(r0 + patch, (br + 1) * size)
                            j0, j1 = max(c0, bc * size), min(c0 + patch, (bc + 1) * size)
                            rows.append((br, bc, r0, c0, own[:, i0 - r0 : i1 - r0, j0 - c0 : j1 - c0].tobytes()))
                yield pd.DataFrame(rows, columns=["br", "bc", "r0", "c0", "scores"])

    def blend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = key
        weight, total, seen = hann(patch), None, np.zeros((size, size))
        for r0, c0, scores in sorted(zip(pdf["r0"], pdf["c0"], pdf["scores"]), key=lambda x: x[:2]):  # one order of sums, whatever that of the rows
            i0, i1 = max(r0, br * size), min(r0 + patch, (br + 1) * size)
            j0, j1 = max(c0, bc * size), min(c0 + patch, (bc + 1) * size)
            own = np.frombuffer(scores).reshape(-1, i1 - i0, j1 - j0)
            total = np.zeros((len(own), size, size)) if total is None else total
            here = np.s_[i0 - br * size : i1 - br * size, j0 - bc * size : j1 - bc * size]
            total[:, here[0], here[1]] += own
            seen[here] += weight[i0 - r0 : i1 - r0, j0 - c0 : j1 - c0]
        if missing is not None:
            seen = np.where(total.sum(0) > 0, seen, 0.0)  # the shares of a known cell add up to its weights
        mean = total / np.maximum(seen, 1e-8)
        code = np.where(seen > 0, mean.argmax(0), -1)
        return pd.DataFrame({"br": [br], "bc": [bc], "code": [code.ravel().astype(np.int32)], "score": [mean.max(0).ravel()]})

    pieces = windows.select(F.col("r0").cast("int"), F.col("c0").cast("int"), "data").mapInPandas(score, "br int, bc int, r0 int, c0 int, scores binary")
    return pieces.groupBy("br", "bc").applyInPandas(blend, "br int, bc int, code array<int>, score array<double>")
