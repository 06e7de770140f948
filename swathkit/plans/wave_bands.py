"""Bands and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import ZSCORE_MEAN, ZSCORE_STD
from ..operators import bands as B
from .catalog import query
from .fixtures import fixture, with_fixtures

KEYS = ["patch_id", "r", "c"]
_R = with_fixtures("fx_rgbi")
_PX = with_fixtures("fx_px")
_CELLS = with_fixtures("fx_cells")
_SAMPLE = with_fixtures("fx_sample")


def r6(c):
    return F.round(c, 6)


@query(_R + "SELECT patch_id, r, c, round((nir-red)/(nir+red+1e-8), 6) AS ndvi FROM fx_rgbi")
def idx_ndvi(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, r6(B.normalized_difference("nir", "red")).alias("ndvi"))


@query(_R + "SELECT patch_id, r, c, round((nir-green)/(nir+green+1e-8), 6) AS gndvi FROM fx_rgbi")
def idx_gndvi(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, r6(B.normalized_difference("nir", "green")).alias("gndvi"))


@query(_R + "SELECT patch_id, r, c, round((nir-red)/(nir+red+0.5::DOUBLE+1e-8)*1.5::DOUBLE, 6) AS savi FROM fx_rgbi")
def idx_savi(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, r6(B.savi("nir", "red")).alias("savi"))


@query(_R + "SELECT patch_id, r, c, round((nir-red)/(nir+red+1e-10), 6) AS ndvi FROM fx_rgbi")
def idx_ndvi_s2(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, r6(B.normalized_difference("nir", "red", 1e-10)).alias("ndvi"))


@query(_R + "SELECT patch_id, r, c, round((red+1)/(green+1+1e-10), 6) AS ratio FROM fx_rgbi")
def idx_vh_vv(spark, d):
    px = fixture(spark, d, "fx_rgbi").select(*KEYS, B.band_ratio(F.col("red") + 1, F.col("green") + 1).alias("ratio"))
    return px.where(B.finite("ratio")).select(*KEYS, r6("ratio").alias("ratio"))


@query(_R + "SELECT patch_id, r, c, (nir-red)/(nir+red+1e-8) >= 0.3::DOUBLE AS vegetation FROM fx_rgbi")
def mask_vegetation(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, B.vegetation_mask("nir", "red").alias("vegetation"))


@query(_R + "SELECT patch_id, round(avg(CASE WHEN (nir-red)/(nir+red+1e-8) >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0 END)*100, 6) AS pct FROM fx_rgbi GROUP BY patch_id")
def veg_cover_pct(spark, d):
    return fixture(spark, d, "fx_rgbi").groupBy("patch_id").agg(r6(F.avg(B.vegetation_mask("nir", "red").cast("double")) * 100).alias("pct"))


@query(_CELLS + "SELECT sum(coalesce((seg<>ref)::INT, 0))::BIGINT AS n_changed, count(seg) AS n_valid, round(100.0::DOUBLE*sum(coalesce((seg<>ref)::INT, 0))/count(seg), 6) AS pct FROM fx_cells")
def mask_diff(spark, d):
    changed = F.sum(F.coalesce((F.col("seg") != F.col("ref")).cast("int"), F.lit(0)))
    return fixture(spark, d, "fx_cells").agg(changed.alias("n_changed"), F.count("seg").alias("n_valid"), r6(changed * F.lit(100.0) / F.count("seg")).alias("pct"))


@query(_CELLS + "SELECT l_orderkey, l_linenumber, nullif(seg, 9) AS shown FROM fx_cells")
def mask_forest_overlay(spark, d):
    return fixture(spark, d, "fx_cells").select("l_orderkey", "l_linenumber", F.nullif("seg", F.lit(9)).alias("shown"))


@query(_PX + "SELECT patch_id, r, c, CASE WHEN v > 0 THEN round(10*log10(v), 6) END AS db FROM fx_px")
def db_convert(spark, d):
    return fixture(spark, d, "fx_px").select(*KEYS, r6(B.decibels("v")).alias("db"))


@query(_CELLS + "SELECT l_orderkey, l_linenumber, coalesce(seg, 9) AS seg, coalesce(flair, 0) AS flair FROM fx_cells")
def fill_na(spark, d):
    return fixture(spark, d, "fx_cells").na.fill({"seg": 9, "flair": 0}).select("l_orderkey", "l_linenumber", "seg", "flair")


@query(_PX + "SELECT patch_id, r, c, round(greatest(0::DOUBLE, least(30::DOUBLE, v*100)), 6) AS held FROM fx_px")
def clamp(spark, d):
    return fixture(spark, d, "fx_px").select(*KEYS, r6(B.clamp(F.col("v") * 100, 0.0, 30.0)).alias("held"))


@query(_R + "SELECT patch_id, r, c, red, green, blue, nir FROM fx_rgbi")
def band_stack_rgbi(spark, d):
    px = fixture(spark, d, "fx_rgbi")
    return B.stack_bands(px.select(*KEYS, "red", "green", "blue"), px.select(*KEYS, "nir"), KEYS, ["red", "green", "blue", "nir"])


@query(_R + "SELECT patch_id, r, c, round(red/255, 6) AS b0, round(green/255, 6) AS b1, round(blue/255, 6) AS b2, round(nir/255, 6) AS b3 FROM fx_rgbi")
def band_reorder(spark, d):
    px = fixture(spark, d, "fx_rgbi").select(*KEYS, B.reorder(F.array("nir", "red", "green", "blue"), [1, 2, 3, 0]).alias("b"))
    return px.select(*KEYS, *[r6(B.to_unit_range(F.col("b")[i], F.lit(255.0), F.lit("uint8"))).alias(f"b{i}") for i in range(4)])


@query(_R + "SELECT patch_id, r, c, red AS b0, CASE WHEN r=0 THEN red ELSE green END AS b1, CASE WHEN r=0 THEN red ELSE 0::DOUBLE END AS b2, CASE WHEN r=0 THEN red ELSE nir END AS b3 FROM fx_rgbi")
def band_reorder_cir(spark, d):
    bands = F.when(F.col("r") == 0, F.array("red")).otherwise(F.array("nir", "red", "green"))
    px = fixture(spark, d, "fx_rgbi").select(*KEYS, B.reorder_infrared(bands).alias("b"))
    return px.select(*KEYS, *[F.col("b")[i].alias(f"b{i}") for i in range(4)])


@query(_PX + "SELECT patch_id, r, c, v+1 AS DSM, v AS DTM FROM fx_px")
def dem_stack(spark, d):
    px = fixture(spark, d, "fx_px")
    return B.stack_bands(px.select(*KEYS, (F.col("v") + 1).alias("DSM")), px.select(*KEYS, F.col("v").alias("DTM")), KEYS, ["DSM", "DTM"])


@query(_PX + "SELECT patch_id, r, c, v*2 AS SLOPE, v AS DTM FROM fx_px")
def dem_channel_select(spark, d):
    px = fixture(spark, d, "fx_px").select(*KEYS, F.col("v").alias("DTM"), (F.col("v") + 1).alias("DSM"), (F.col("v") * 2).alias("SLOPE"))
    return B.select_channels(px, KEYS, ["slope", "dtm"])


@query(_R + "SELECT band, round(min(v),2) AS v_min, round(max(v),2) AS v_max, round(avg(v),2) AS v_mean, round(stddev_samp(v),2) AS v_sd FROM (SELECT 'red' AS band, red AS v FROM fx_rgbi UNION ALL SELECT 'green', green FROM fx_rgbi UNION ALL SELECT 'blue', blue FROM fx_rgbi UNION ALL SELECT 'nir', nir FROM fx_rgbi) GROUP BY band")
def band_stats(spark, d):
    return B.band_statistics(fixture(spark, d, "fx_rgbi"), ["red", "green", "blue", "nir"])


@query(_R + "SELECT least(50, floor(nir/5.1::DOUBLE)::INT+1)::INT AS bin, count(*) AS n FROM fx_rgbi GROUP BY 1")
def band_histogram(spark, d):
    return B.histogram(fixture(spark, d, "fx_rgbi"), "nir")


@query(_R + "SELECT patch_id, r, c, round(red/CASE WHEN max(red) OVER (PARTITION BY patch_id) > 1 THEN 255.0::DOUBLE ELSE 1 END, 6) AS scaled FROM fx_rgbi")
def scale_optical(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, r6(B.scale_by_max("red", ["patch_id"], 255.0)).alias("scaled"))


@query(_PX + "SELECT patch_id, r, c, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w)/(max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) AS scaled FROM fx_px WINDOW w AS (PARTITION BY patch_id)")
def scale_minmax(spark, d):
    return fixture(spark, d, "fx_px").select(*KEYS, r6(B.scale_min_max("v", ["patch_id"])).alias("scaled"))


@query(_R + "SELECT patch_id, r, c, " + ", ".join(f"round(({n}-{m}::DOUBLE)/({s}::DOUBLE+1e-8), 6) AS {n}" for n, m, s in zip(("red", "green", "blue", "nir"), ZSCORE_MEAN, ZSCORE_STD)) + " FROM fx_rgbi")
def scale_zscore_flair(spark, d):
    return fixture(spark, d, "fx_rgbi").select(*KEYS, *[r6(B.zscore(n, m, s)).alias(n) for n, m, s in zip(("red", "green", "blue", "nir"), ZSCORE_MEAN, ZSCORE_STD)])


@query(_SAMPLE + "SELECT patch_id, modality, round(coalesce((value - m)/greatest(s, 1e-6), value), 6) AS z FROM fx_sample LEFT JOIN (SELECT modality, avg(value) AS m, stddev_pop(value) AS s FROM fx_sample WHERE split='train' AND modality <> 'fr' GROUP BY modality) USING (modality)")
def scale_zscore_ds(spark, d):
    """Statistics of the training split by modality; a modality without them keeps its values."""
    s = fixture(spark, d, "fx_sample")
    stats = s.where("split = 'train' AND modality <> 'fr'").groupBy("modality").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.greatest("s", F.lit(1e-6))
    return s.join(stats, "modality", "left").select("patch_id", "modality", r6(F.coalesce(z, "value")).alias("z"))


@query(_PX + "SELECT patch_id, r, c, round((v*2+3) - v, 6) AS chm FROM fx_px")
def chm(spark, d):
    return fixture(spark, d, "fx_px").select(*KEYS, r6(F.col("v") * 2 + 3 - F.col("v")).alias("chm"))


@query(_PX + "SELECT patch_id, r, c, v FROM fx_px WHERE v > 0")
def filter_finite(spark, d):
    """Cells whose logarithm is finite."""
    px = fixture(spark, d, "fx_px").select(*KEYS, "v", F.when(F.col("v") > 0, F.log("v")).otherwise(F.lit(float("nan"))).alias("l"))
    return px.where(B.finite("l")).drop("l")


