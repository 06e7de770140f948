"""Raster geometry on cell tables (keys, row, column, value): neighbourhoods, resampling, mosaics, crops.

Neighbourhoods take two window passes instead of a self-join. Resampling gives each source cell its few targets from a
small table for each axis (twice the target's side at most) and sums them up, so it shuffles once, after partial sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bands, blocks


def focal_3x3(df: DataFrame, row: str, col: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Adds a..i, the 3 x 3 neighbourhood read along rows (e is the cell); null where a neighbour is missing."""
    keys = keys or []

    def beside(c: str, at: str, w, step: int) -> Column:
        shift = F.lag if step < 0 else F.lead
        return F.when(shift(at, 1).over(w) == F.col(at) + step, shift(c, 1).over(w))

    along = Window.partitionBy(*keys, row).orderBy(col)
    across = Window.partitionBy(*keys, col).orderBy(row)
    one = df.withColumns({"_d": beside(value, col, along, -1), "_f": beside(value, col, along, 1)}).withColumn("_line", F.struct("_d", F.col(value).alias("_e"), "_f"))
    two = one.withColumns({"_up": beside("_line", row, across, -1), "_down": beside("_line", row, across, 1)})
    names = {"a": "_up._d", "b": "_up._e", "c": "_up._f", "d": "_d", "e": value, "f": "_f", "g": "_down._d", "h": "_down._e", "i": "_down._f"}
    return two.select(*df.columns, *[F.col(x).alias(f"n_{k}") for k, x in names.items()])


def gradients(cell: float = 1.0) -> tuple[Column, Column]:
    """dz/dx and dz/dy (down the rows) after Horn, of the columns that ``focal_3x3`` adds."""
    n = {k: F.col(f"n_{k}") for k in "abcdefghi"}
    dx = ((n["c"] + n["f"] * 2 + n["i"]) - (n["a"] + n["d"] * 2 + n["g"])) / (8 * cell)
    dy = ((n["g"] + n["h"] * 2 + n["i"]) - (n["a"] + n["b"] * 2 + n["c"])) / (8 * cell)
    return dx, dy


def slope(cell: float = 1.0) -> Column:
    """Slope in radians; null at the border."""
    dx, dy = gradients(cell)
    return F.atan(F.sqrt(dx * dx + dy * dy))


def aspect(cell: float = 1.0) -> Column:
    """Direction of the fall in degrees from north, clockwise; flat cells have 0."""
    dx, dy = gradients(cell)
    angle = F.degrees(F.atan2(-dx, dy))
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).when(angle < 0, angle + 360).otherwise(angle)


def position_index() -> Column:
    """The cell less the mean of its eight neighbours."""
    rest = [F.col(f"n_{k}") for k in "abcdfghi"]
    total = rest[0]
    for x in rest[1:]:
        total = total + x
    return F.col("n_e") - total / 8


def wetness(slope_radians: Column, cell: float = 1.0) -> Column:
    raw = F.log(F.lit(cell) / F.greatest(F.tan(slope_radians), F.lit(0.001)))
    return F.when(slope_radians.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(30.0), raw)))


def axis_weights(spark: SparkSession, source: int, target: int, how: str) -> DataFrame:
    """src, dst, w of an axis. nearest: the source cell that holds the target's centre; bilinear: the two next centres
    (those outside are left out); replicate: the same with the edge cells going on outwards."""
    rows: dict[tuple[int, int], float] = {}
    for t in range(target):
        at = (t + 0.5) * source / target
        if how == "nearest":
            rows[(min(source - 1, math.floor(at)), t)] = 1.0
            continue
        at -= 0.5
        if how == "replicate":
            at = max(0.0, at)
        low = math.floor(at)
        for i, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            if how == "replicate":
                i = min(max(i, 0), source - 1)
            if 0 <= i < source and w > 0:
                rows[(i, t)] = rows.get((i, t), 0.0) + w
    return spark.createDataFrame([(s, t, w) for (s, t), w in rows.items()], "src int, dst int, w double")


def resample(df: DataFrame, keys: list[str], row: str, col: str, value: str, source: tuple[int, int], target: tuple[int, int], how: str = "bilinear") -> DataFrame:
    """keys, row, col, value on the target grid; null cells count for nothing and the other weights are scaled up."""
    spark = df.sparkSession
    rows = axis_weights(spark, source[0], target[0], how).select(F.col("src").alias(row), F.col("dst").alias("_r"), F.col("w").alias("_wr"))
    cols = axis_weights(spark, source[1], target[1], how).select(F.col("src").alias(col), F.col("dst").alias("_c"), F.col("w").alias("_wc"))
    parts = df.where(F.col(value).isNotNull()).join(F.broadcast(rows), row).join(F.broadcast(cols), col)
    w = F.col("_wr") * F.col("_wc")
    return parts.groupBy(*keys, F.col("_r").alias(row), F.col("_c").alias(col)).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def block_mean(df: DataFrame, keys: list[str], row: str, col: str, value: str, factor: int) -> DataFrame:
    return df.groupBy(*keys, F.expr(f"CAST({row} DIV {factor} AS INT)").alias(row), F.expr(f"CAST({col} DIV {factor} AS INT)").alias(col)).agg(F.avg(value).alias(value))


def reduction_factor(cells: int, most: int) -> int:
    return max(1, math.ceil(math.sqrt(cells / most)))


def merge_tiles(df: DataFrame, cell: list[str], order: str, value: str) -> DataFrame:
    """Overlapping tiles as one raster: of each cell, the first tile that has a value."""
    return df.where(F.col(value).isNotNull()).groupBy(*cell).agg(F.min_by(value, order).alias(value))


def aligned(df: DataFrame, keys: list[str], row: str, col: str, value: str, own: dict, ref: dict) -> DataFrame:
    """keys, row, col, value of rasters on the grid of a reference of the same extent: as they are if the grids agree, else resampled."""
    if same_grid(own, ref):
        return df.select(*keys, row, col, value)
    return resample(df, keys, row, col, value, (own["nrow"], own["ncol"]), (ref["nrow"], ref["ncol"]))


def crop_or_pad(df: DataFrame, keys: list[str], row: str, col: str, value: str, size: tuple[int, int], target: int) -> DataFrame:
    """The middle of each raster of ``size`` cells as keys, row, col, value, with zeros around it where it is smaller than the target, and where a cell is missing."""
    side = max(size)
    whole = blocks.to_blocks(df.where(F.col(row).between(0, size[0] - 1) & F.col(col).between(0, size[1] - 1)), row, col, value, side, keys)
    made = whole.select(*keys, F.posexplode(blocks.crop_or_pad("data", *size, target, side)).alias("_at", value))
    return made.select(*keys, F.expr(f"CAST(_at DIV {target} AS INT)").alias(row), (F.col("_at") % target).alias(col), value)


def flip(df: DataFrame, row: str, col: str, height: int, width: int, down: Column, across: Column) -> DataFrame:
    return df.withColumns({row: F.when(down, height - 1 - F.col(row)).otherwise(F.col(row)), col: F.when(across, width - 1 - F.col(col)).otherwise(F.col(col))})


def crop_extent(df: DataFrame, row: str, col: str, box: tuple[float, float, float, float], origin: tuple[float, float], res: float) -> DataFrame:
    """Cells of a raster (upper left corner ``origin``) whose centres lie in a box, as plain range filters."""
    x0, y0, x1, y1 = box
    lo_c, hi_c = math.ceil((x0 - origin[0]) / res - 0.5), math.floor((x1 - origin[0]) / res - 0.5)
    lo_r, hi_r = math.ceil((origin[1] - y1) / res - 0.5), math.floor((origin[1] - y0) / res - 0.5)
    return df.where(F.col(row).between(lo_r, hi_r) & F.col(col).between(lo_c, hi_c))


def elevation_pair(terrain: DataFrame, surface: DataFrame | None, cell: list[str], value: str, least_pct: float = 10.0, fallback: bool = True) -> DataFrame:
    """cell, DSM, DTM, dsm_source: terrain with a surface model of enough coverage, else (``fallback``) with itself, else nothing.

    Coverage is the share of the surface's cells that are finite and not 0; no surface has none. A terrain model without a cell is an
    error. The decision takes one row to the driver.
    """
    if terrain.isEmpty():
        raise ValueError("no terrain model")
    dtm = terrain.select(*cell, F.col(value).alias("DTM"))
    fine = bands.finite(value) & (F.col(value) != 0)
    n, known = surface.agg(F.count(F.lit(1)), F.count_if(fine)).first() if surface is not None else (0, 0)
    if n and 100.0 * known / n >= least_pct:
        return dtm.join(surface.select(*cell, F.col(value).alias("DSM")), cell).select(*cell, "DSM", "DTM", F.lit("surface").alias("dsm_source"))
    pair = dtm.select(*cell, F.col("DTM").alias("DSM"), "DTM", F.lit("terrain_fallback").alias("dsm_source"))
    return pair if fallback else pair.limit(0)


def stack_bands(long: DataFrame, keys: list[str], row: str, col: str, value: str, band: str, wanted: list[str], sizes: dict[str, int], target: int) -> DataFrame:
    """keys, row, col and a column for each wanted band that there is: bands of ``sizes`` cells a side on one template of ``target``, bilinear.

    Bands without a row are left out, as are those that aren't wanted; cells that no band covers have no row.
    """
    there = [r[band] for r in long.where(F.col(band).isin(wanted)).select(band).distinct().collect()]  # names of bands
    out = None
    for name in [b for b in wanted if b in there]:
        own = long.where(F.col(band) == name).select(*keys, row, col, value)
        own = own if sizes[name] == target else resample(own, keys, row, col, value, (sizes[name], sizes[name]), (target, target))
        own = own.withColumn(band, F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no band")
    return out.groupBy(*keys, row, col).pivot(band, [b for b in wanted if b in there]).agg(F.first(value))


def stack_patches(df: DataFrame, keys: list[str], row: str, col: str, bands: dict[str, int], target: int) -> DataFrame:
    """keys, row, col and a column for each band: as ``stack_bands``, of patches that hold each band in one array along its rows.

    ``bands`` names the array columns and their cells a side. A row is resampled by itself, so nothing is shuffled or grouped and
    a task holds one patch; a cell that no known cell of a band covers is null in it.
    """
    on = [(F.col(b) if n == target else blocks.resampled(b, n, target)).alias(b) for b, n in bands.items()]
    told = df.select(*keys, *on).select(*keys, F.posexplode(F.arrays_zip(*bands)).alias("_at", "_cell"))
    return told.select(*keys, F.expr(f"CAST(_at DIV {target} AS INT)").alias(row), (F.col("_at") % target).alias(col), *[F.col("_cell")[b].alias(b) for b in bands])


def same_grid(a: dict, b: dict, tolerance: float = 1e-9) -> bool:
    """Whether two rasters' descriptions (epsg, xmin, ymax, res, nrow, ncol) name one grid: then no resampling is needed."""
    return all(abs(a[k] - b[k]) <= tolerance for k in ("epsg", "xmin", "ymax", "res", "nrow", "ncol"))


def extract_windows(df: DataFrame, row: str, col: str, value: str, patches: DataFrame, step: int, window: int, size: int, block: int = blocks.BLOCK) -> DataFrame:
    """patch_id, i, j, value: square windows of ``window`` cells around the patches' middles, resampled to ``size``.

    ``patches`` has patch_id, py, px: the patch's row and column in a grid of ``step`` cells. The raster becomes blocks, of which
    the windows are sliced; what lies outside of the raster is null.
    """
    margin = (window - step) // 2  # how far a window reaches beyond its patch
    places = patches.select("patch_id", (F.col("py") * step - margin).alias("r0"), (F.col("px") * step - margin).alias("c0"), F.lit(window).alias("height"), F.lit(window).alias("width"))
    cut = blocks.cut(blocks.to_blocks(df, row, col, value, block), places, block)
    data = blocks.resampled("data", window, size) if window != size else F.col("data")
    told = cut.select("patch_id", F.posexplode(data).alias("_at", value))
    return told.select("patch_id", F.expr(f"CAST(_at DIV {size} AS INT)").alias("i"), (F.col("_at") % size).alias("j"), value)


def as_patches(df: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """One row for each patch, its values along rows in one array."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(row, col, value))), lambda x: x[value]).alias("data"))
