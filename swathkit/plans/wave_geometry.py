"""Raster geometry: neighbourhoods, terrain, resampling, mosaics, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as K
from ..operators import raster as R
from ..sources import storage
from .catalog import query
from .fixtures import fixture, with_fixtures

_PX = with_fixtures("fx_px")
_MOSAIC = "m AS (SELECT ((patch_id // 25)*8 + r)::INTEGER AS gr, ((patch_id % 25)*8 + c)::INTEGER AS gc, v FROM fx_px)"
_LINE = "l AS (SELECT gr, gc, v AS e, lag(v) OVER w AS d, lead(v) OVER w AS f FROM m WINDOW w AS (PARTITION BY gr ORDER BY gc)), n AS (SELECT gr, gc, lag(d) OVER w AS a, lag(e) OVER w AS b, lag(f) OVER w AS c, d, e, f, lead(d) OVER w AS g, lead(e) OVER w AS h, lead(f) OVER w AS i FROM l WINDOW w AS (PARTITION BY gc ORDER BY gr))"
_GRAD = ", q AS (SELECT gr, gc, ((c+2*f+i)-(a+2*d+g))/8 AS dx, ((g+2*h+i)-(a+2*b+c))/8 AS dy FROM n)"
_N = with_fixtures("fx_px", also=f"{_MOSAIC}, {_LINE}{_GRAD}")


def _mosaic(spark, d):
    px = fixture(spark, d, "fx_px")
    return px.select(F.expr("CAST((patch_id DIV 25)*8 + r AS INT)").alias("gr"), F.expr("CAST((patch_id % 25)*8 + c AS INT)").alias("gc"), "v")


def _near(spark, d):
    return R.focal_3x3(_mosaic(spark, d), "gr", "gc", "v")


@query(_N + "SELECT gr, gc, round(a+b+c+d+e+f+g+h+i, 6) AS total FROM n WHERE a IS NOT NULL AND c IS NOT NULL AND g IS NOT NULL AND i IS NOT NULL")
def focal_3x3(spark, d):
    total = sum((F.col(f"n_{k}") for k in "bcdefghi"), F.col("n_a"))
    return _near(spark, d).select("gr", "gc", F.round(total, 6).alias("total")).where("total IS NOT NULL")


@query(_N + "SELECT gr, gc, d AS west, f AS east, b AS north, h AS south FROM n")
def join_neighbours(spark, d):
    return _near(spark, d).select("gr", "gc", F.col("n_d").alias("west"), F.col("n_f").alias("east"), F.col("n_b").alias("north"), F.col("n_h").alias("south"))


@query(_N + "SELECT gr, gc, round(degrees(atan(sqrt(dx*dx+dy*dy))), 6) AS slope FROM q")
def terrain_slope(spark, d):
    return _near(spark, d).select("gr", "gc", F.round(F.degrees(R.slope()), 6).alias("slope"))


@query(_N + "SELECT gr, gc, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 6) AS aspect FROM q")
def terrain_aspect(spark, d):
    return _near(spark, d).select("gr", "gc", F.round(R.aspect(), 6).alias("aspect"))


@query(_N + "SELECT gr, gc, round(e-(a+b+c+d+f+g+h+i)/8, 6) AS tpi FROM n")
def terrain_tpi(spark, d):
    return _near(spark, d).select("gr", "gc", F.round(R.position_index(), 6).alias("tpi"))


@query(_N + "SELECT gr, gc, CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN round(greatest(0::DOUBLE, least(30::DOUBLE, ln(1/greatest(tan(atan(sqrt(dx*dx+dy*dy))), 0.001::DOUBLE)))), 6) END AS twi FROM q")
def terrain_twi(spark, d):
    return _near(spark, d).select("gr", "gc", F.round(R.wetness(R.slope()), 6).alias("twi"))


@query(_PX + "SELECT patch_id, i::INTEGER AS r, j::INTEGER AS c, v FROM fx_px JOIN range(12) a(i) ON r = floor((i+0.5)*8/12)::INTEGER JOIN range(12) b(j) ON c = floor((j+0.5)*8/12)::INTEGER")
def resample_nearest(spark, d):
    return R.resample(fixture(spark, d, "fx_px"), ["patch_id"], "r", "c", "v", (8, 8), (12, 12), "nearest")


def _bilinear(n, m, clamp):
    """Target cells with their four neighbours and weights, as SQL."""
    s = f"(t+0.5::DOUBLE)*{n}/{m}-0.5::DOUBLE"
    s = f"greatest({s}, 0)" if clamp else s
    pick = f"least(greatest(i, 0), {n - 1})" if clamp else "i"
    return f"ax AS (SELECT t::INTEGER AS t, {pick}::INTEGER AS i, w FROM (SELECT t, floor(s) AS i, 1-(s-floor(s)) AS w FROM (SELECT t, {s} AS s FROM range({m}) k(t)) UNION ALL SELECT t, floor(s)+1, s-floor(s) FROM (SELECT t, {s} AS s FROM range({m}) k(t))) WHERE w > 0)"


_BI = "SELECT patch_id, y.t AS r, x.t AS c, round(sum(v*x.w*y.w)/sum(x.w*y.w), 6) AS v FROM fx_px JOIN ax y ON r = y.i JOIN ax x ON c = x.i GROUP BY ALL"


def _rounded(df, *keys):
    return df.select(*keys, F.round("v", 6).alias("v"))


@query(with_fixtures("fx_px", also=_bilinear(8, 5, False)) + _BI)
def resample_bilinear(spark, d):
    return _rounded(R.resample(fixture(spark, d, "fx_px"), ["patch_id"], "r", "c", "v", (8, 8), (5, 5), "bilinear"), "patch_id", "r", "c")


@query(with_fixtures("fx_px", also=_bilinear(8, 16, True)) + _BI)
def resample_bilinear_t(spark, d):
    return _rounded(R.resample(fixture(spark, d, "fx_px"), ["patch_id"], "r", "c", "v", (8, 8), (16, 16), "replicate"), "patch_id", "r", "c")


@query(with_fixtures("fx_px", also=_bilinear(8, 10, False)) + "SELECT 'same' AS grid, patch_id, r, c, round(v, 6) AS v FROM fx_px UNION ALL SELECT 'finer', * FROM (" + _BI + ")")
def align_grid(spark, d):
    """Rasters on the grid of a reference: one that is on it is left as it is, one that isn't is resampled."""
    px = fixture(spark, d, "fx_px").select("patch_id", "r", "c", "v")
    own = {"epsg": 2154, "xmin": 0.0, "ymax": 8.0, "res": 1.0, "nrow": 8, "ncol": 8}
    out = [R.aligned(px, ["patch_id"], "r", "c", "v", own, ref).select(F.lit(k).alias("grid"), "patch_id", "r", "c", F.round("v", 6).alias("v")) for k, ref in (("same", dict(own)), ("finer", own | {"res": 0.8, "nrow": 10, "ncol": 10}))]
    return out[0].union(out[1])


@query(with_fixtures("fx_px", also=_bilinear(8, 20, False)) + _BI)
def align_sentinel(spark, d):
    """A coarse raster on the finer template of a reference extent."""
    return _rounded(R.resample(fixture(spark, d, "fx_px"), ["patch_id"], "r", "c", "v", (8, 8), (20, 20), "bilinear"), "patch_id", "r", "c")


@query(_PX + "SELECT patch_id, (r // 2)::INTEGER AS r, (c // 2)::INTEGER AS c, round(avg(v), 6) AS v FROM fx_px GROUP BY ALL")
def downsample_mean(spark, d):
    return _rounded(R.block_mean(fixture(spark, d, "fx_px"), ["patch_id"], "r", "c", "v", R.reduction_factor(64, 16)), "patch_id", "r", "c")


@query(_PX + "SELECT r, c, min_by(v, patch_id) AS v FROM fx_px WHERE NOT (patch_id % 3 = 0 AND r < 4) GROUP BY r, c")
def mosaic_merge(spark, d):
    tiles = fixture(spark, d, "fx_px").select("patch_id", "r", "c", F.when(~((F.col("patch_id") % 3 == 0) & (F.col("r") < 4)), F.col("v")).alias("v"))
    return R.merge_tiles(tiles, ["r", "c"], "patch_id", "v")


@query(_PX + "SELECT patch_id, i::INTEGER AS r, j::INTEGER AS c, coalesce(v, 0) AS v FROM (SELECT DISTINCT patch_id FROM fx_px) p, range(11) a(i), range(11) b(j) LEFT JOIN fx_px x ON x.patch_id = p.patch_id AND x.r = i - 2 AND x.c = j - 2".replace("SELECT patch_id, i", "SELECT p.patch_id, i"))
def center_crop_pad(spark, d):
    """Small patches in the middle of larger ones, as arrays."""
    patches = K.to_blocks(fixture(spark, d, "fx_px"), "r", "c", "v", 8, ["patch_id"])
    made = patches.select("patch_id", F.posexplode(K.crop_or_pad("data", 8, 8, 11)).alias("at", "v"))
    return made.select("patch_id", F.expr("CAST(at DIV 11 AS INT)").alias("r"), (F.col("at") % 11).alias("c"), "v")


@query(_PX + "SELECT patch_id, CASE WHEN patch_id % 2 = 0 THEN 7-r ELSE r END AS r, CASE WHEN patch_id % 3 = 0 THEN 7-c ELSE c END AS c, v FROM fx_px")
def flip_augment(spark, d):
    return R.flip(fixture(spark, d, "fx_px").select("patch_id", "r", "c", "v"), "r", "c", 8, 8, F.col("patch_id") % 2 == 0, F.col("patch_id") % 3 == 0)


@query(_PX + "SELECT a.patch_id, a.r, a.c, round(a.v - b.v, 6) AS diff FROM fx_px a JOIN fx_px b ON b.patch_id = a.patch_id + 1 AND b.r = a.r AND b.c = a.c")
def join_cell(spark, d):
    px = fixture(spark, d, "fx_px").select("patch_id", "r", "c", "v")
    other = px.select((F.col("patch_id") - 1).alias("patch_id"), "r", "c", F.col("v").alias("w"))
    return px.join(other, ["patch_id", "r", "c"]).select("patch_id", "r", "c", F.round(F.col("v") - F.col("w"), 6).alias("diff"))


@query(with_fixtures("fx_px", also=_MOSAIC) + "SELECT gr, gc, v FROM m WHERE gr BETWEEN 4 AND 9 AND gc BETWEEN 3 AND 12")
def join_crop_extent(spark, d):
    return R.crop_extent(_mosaic(spark, d), "gr", "gc", (3.0, 150.0, 13.0, 156.2), (0.0, 160.0), 1.0)


#: A patch for every 16 x 16 cells of the mosaic, 13 a row; those at its sides lie partly beyond it.
_P = "p AS (SELECT DISTINCT (gr // 16 * 13 + gc // 16)::INTEGER AS patch_id, (gr // 16)::INTEGER AS iy, (gc // 16)::INTEGER AS ix FROM m)"
BLOCK = 64


def _patches(blocks, margin, window):
    """Windows around the patches of a raster's blocks."""
    at = lambda b: F.explode(F.sequence(F.col(b) * (BLOCK // 16), F.col(b) * (BLOCK // 16) + BLOCK // 16 - 1))
    inside = lambda y, x: F.exists(F.sequence(F.lit(0), F.lit(255)), lambda k: F.get("data", (F.floor(k / 16).cast("int") + y * 16) * BLOCK + k % 16 + x * 16).isNotNull())
    grid = blocks.select("data", "br", "bc", at("br").alias("iy")).select("data", "br", "bc", "iy", at("bc").alias("ix"))
    full = grid.where(inside(F.col("iy") - F.col("br") * (BLOCK // 16), F.col("ix") - F.col("bc") * (BLOCK // 16)))
    return full.select((F.col("iy") * 13 + F.col("ix")).alias("patch_id"), (F.col("iy") * 16 - margin).alias("r0"), (F.col("ix") * 16 - margin).alias("c0"), F.lit(window).alias("height"), F.lit(window).alias("width"))


def _long(df, size):
    return df.select(*[c for c in df.columns if c != "data"], F.posexplode("data").alias("at", "v")).withColumns({"i": F.expr(f"CAST(at DIV {size} AS INT)"), "j": F.col("at") % size}).drop("at")


def _window_sql(step, window, size, name):
    margin = (window - step) // 2
    return f"SELECT p.patch_id, '{name}' AS modality, y.t AS i, x.t AS j, round(sum(v*x.w*y.w)/sum(CASE WHEN v IS NOT NULL THEN x.w*y.w END), 6) AS v FROM p JOIN ax{size} y ON true JOIN ax{size} x ON true LEFT JOIN m ON gr = iy*{step}-{margin}+y.i AND gc = ix*{step}-{margin}+x.i GROUP BY ALL"


_AX8, _AX6 = _bilinear(16, 8, False).replace("ax AS", "ax8 AS"), _bilinear(24, 6, False).replace("ax AS", "ax6 AS")


@query(with_fixtures("fx_px", also=f"{_MOSAIC}, {_P}, {_AX8}, {_AX6}") + f"SELECT * FROM ({_window_sql(16, 16, 8, 'aerial')} UNION ALL {_window_sql(16, 24, 6, 's2')})")
def extract_patches(spark, d):
    """Two modalities with windows of their own around all patches of a raster, one wider than the patch."""
    blocks = storage.written(K.to_blocks(_mosaic(spark, d), "gr", "gc", "v", BLOCK), "blocks")
    out = []
    for name, window, size in (("aerial", 16, 8), ("s2", 24, 6)):
        cut = K.cut(blocks, _patches(blocks, (window - 16) // 2, window), BLOCK)
        out.append(_long(cut.select("patch_id", F.lit(name).alias("modality"), K.resampled("data", window, size).alias("data")), size).withColumn("v", F.round("v", 6)))
    return out[0].unionByName(out[1]).select("patch_id", "modality", "i", "j", "v")


@query(with_fixtures("fx_px", also=f"{_MOSAIC}, {_P}") + "SELECT p.patch_id, i::INTEGER AS i, j::INTEGER AS j, v FROM p, range(16) a(i), range(16) b(j) LEFT JOIN m ON gr = iy*16+i AND gc = ix*16+j")
def extract_patches_single(spark, d):
    """All patches of a raster; those that partly lie beyond it have nulls there."""
    blocks = storage.written(K.to_blocks(_mosaic(spark, d), "gr", "gc", "v", BLOCK), "blocks")
    return _long(K.cut(blocks, _patches(blocks, 0, 16), BLOCK).select("patch_id", "data"), 16).select("patch_id", "i", "j", "v")
