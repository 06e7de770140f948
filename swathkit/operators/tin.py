"""Heights of scattered points on a grid by linear interpolation in a Delaunay triangulation.

Points are dealt to tiles, each with a halo of its neighbours' points, and triangulated tile by tile. A triangle is Delaunay in
the whole cloud if its circumcircle lies where all points are at hand; so with circumcircles held to a radius of ``reach``, a
halo of twice that makes each tile's cells those of one triangulation of everything, whatever the tiles.

Four points on one circle would leave the choice of the diagonal to chance (lattices are full of them). The tie is broken by
raising each point on the paraboloid by an infinitesimal that is larger the earlier the point comes by (x, y), so the
triangulation depends on the points alone, not on their order or tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _delaunay as D

LEAST_POINTS = 4


def _column(points: pd.DataFrame, gx: np.ndarray, gy: np.ndarray, reach: float, fill: bool) -> np.ndarray:
    """Heights at some places: from the triangle around each, else (``fill``) from the nearest point; nan where neither is within reach."""
    return _heights(*(points[c].to_numpy(np.float64) for c in "xyz"), gx, gy, reach, fill)


def _heights(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray, reach: float, fill: bool) -> np.ndarray:
    order = np.lexsort((z, y, x))  # one order of sums, whatever that of the rows
    x, y, z = x[order], y[order], z[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])) if len(x) else np.zeros(0, int)
    mean = np.add.reduceat(z, fresh) / np.diff([*fresh, len(z)]) if len(x) else z
    return D.interpolate(x[fresh], y[fresh], mean, gx, gy, reach, fill)


def patch_heights(points: DataFrame, patch: str, frame: tuple[float, float, float, float] | None, n: int, footprint: tuple[float, float] | None = None) -> DataFrame:
    """patch, row, col, dsm, dtm of an ``n`` x ``n`` grid over each patch; row 0 is the top.

    ``points`` has patch, x, y, z, cls, return_number. The terrain takes ground points (class 2), the surface first returns;
    where a patch has fewer than four of a kind, all its points count, and with fewer than four in all its heights are null.
    Cells outside the triangles take the nearest point. The grid spans ``frame``, or the patch's own extent; then, with a
    ``footprint``, patches whose width or height is out of that range are left out. Points at one place count as one at their
    mean height; points with a null or infinite coordinate are left out; a patch without points has no rows.
    """
    real = [F.collect_list(F.col(c).cast("double")).alias(c) for c in "xyz"]
    chosen = [F.collect_list(F.coalesce(k, F.lit(False)).cast("int")).alias(n) for n, k in (("dsm", F.col("return_number") == 1), ("dtm", F.col("cls") == 2))]
    kind = dict(points.dtypes)[patch]
    row, col = (k.ravel() for k in np.mgrid[0:n, 0:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # many patches at once, their points in flat arrays
            if not len(batch):
                continue
            starts = np.concatenate([[0], np.cumsum(batch.column("x").value_lengths().to_numpy())])
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("x", "y", "z", "dsm", "dtm")}
            kept, out = [], {"dsm": [], "dtm": []}
            for k in range(len(batch)):
                here = slice(starts[k], starts[k + 1])
                x, y, z = (flat[c][here] for c in "xyz")
                x0, y0, x1, y1 = frame or (x.min(), y.min(), x.max(), y.max())
                if footprint and not (footprint[0] <= x1 - x0 <= footprint[1] and footprint[0] <= y1 - y0 <= footprint[1]):
                    continue
                gx, gy = x0 + (col + 0.5) * ((x1 - x0) / n), y1 - (row + 0.5) * ((y1 - y0) / n)
                kept.append(k)
                for name, found in out.items():
                    own = np.flatnonzero(flat[name][here])
                    at = own if len(own) >= LEAST_POINTS else slice(None)
                    found.append(_heights(x[at], y[at], z[at], gx, gy, math.inf, True) if len(x[at]) >= LEAST_POINTS else np.full(n * n, np.nan))
            heights = {name: np.concatenate([np.empty(0), *found]) for name, found in out.items()}
            places = {"row": np.tile(row, len(kept)).astype(np.int32), "col": np.tile(col, len(kept)).astype(np.int32)}
            ids = batch.column(patch).take(pa.array(np.repeat(np.array(kept, np.int64), n * n)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in places.values()), *(pa.array(v, mask=np.isnan(v)) for v in heights.values())], names=[patch, *places, *heights])

    return points.where(_usable("x", "y", "z")).groupBy(patch).agg(*real, *chosen).mapInArrow(run, f"{patch} {kind}, row int, col int, dsm double, dtm double")


def area_heights(points: DataFrame, cell: float, tile: float, reach: float, fill: bool = False) -> DataFrame:
    """cx, cy, z of the cells (numbered from the origin) whose centre lies in a triangle with a circumradius of at most ``reach``.

    ``points`` has x, y, z. With ``fill``, other cells take the nearest point up to twice ``reach`` away; cells beyond have no
    row. ``tile`` (a multiple of ``cell``) says how the work is dealt and changes no result: a point goes to every tile within
    twice ``reach`` of it, four at most if tiles are four times ``reach`` wide. Points at one place count as one at their mean
    height; points with a null or infinite coordinate are left out.
    """
    steps = round(tile / cell)
    if steps < 1 or abs(steps * cell - tile) > 1e-9 * tile:
        raise ValueError("a tile must be a multiple of a cell")
    halo = 2 * reach
    whole = points.where(_usable("x", "y", "z")).groupBy("x", "y").agg(F.avg("z").alias("z"))
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    dealt = whole.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cy = (k.ravel() + int(t) * steps for k, t in zip(np.mgrid[0:steps, 0:steps], key))
        z = _column(pdf, (cx + 0.5) * cell, (cy + 0.5) * cell, reach, fill)
        known = ~np.isnan(z)
        return pd.DataFrame({"cx": cx[known], "cy": cy[known], "z": z[known]})

    return dealt.groupBy("tx", "ty").applyInPandas(run, "cx long, cy long, z double")


def _usable(*names: str):
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return out
