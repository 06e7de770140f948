"""Properties and edge cases of operators on tiny tables."""

import math
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from swathkit.functions.dims import DIMS, dim
from swathkit.operators import bands, classes, grids, overlay, raster, scoring, temporal, zonal
from swathkit.sources import services, storage


def one(df):
    return tuple(df.first())


def test_class_tables(spark):
    rows = dim(spark, "dim_essences").orderBy("code").collect()
    assert [r["code"] for r in rows] == list(range(13)) and rows[0]["classe"] == "Chene decidu"
    assert {r["type"] for r in rows} == {"feuillu", "resineux"}
    assert [len(DIMS[k][1]) for k in ("dim_treesatai", "dim_ndp0", "dim_cosia", "dim_cosia15", "dim_lpis", "dim_models", "dim_s2_bands", "dim_domains")] == [7, 10, 16, 15, 23, 3, 10, 20]


def test_modality_specs(spark):
    for r in dim(spark, "modality_specs").collect():
        assert r["image_size"] % r["patch_size_mae"] == 0
        assert math.isclose(r["window_m"], r["image_size"] * r["resolution"])


def test_indices_with_null_and_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 0.0), (3.0, 1.0)], "nir double, red double")
    got = [r[0] for r in df.select(bands.normalized_difference("nir", "red").alias("x")).collect()]
    assert got[0] is None and got[1] == 0 and abs(got[2] - 0.5) < 1e-6
    assert [r[0] for r in df.select(bands.vegetation_mask("nir", "red")).collect()] == [None, False, True]
    assert [r[0] for r in df.select(bands.clamp("nir", 1.0, 2.0)).collect()] == [None, 1.0, 2.0]
    assert [r[0] for r in df.select(bands.decibels("nir")).collect()][:2] == [None, None]


def test_unknown_channels_are_errors(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, DSM double, DTM double")
    assert bands.select_channels(df, ["id"], ["dtm"]).columns == ["id", "DTM"]
    for wrong in (["HEIGHT"], [], ["DTM"] * 7):
        with pytest.raises(ValueError):
            bands.select_channels(df, ["id"], wrong)


def test_constant_band_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "g int, v double")
    assert sorted(r[0] for r in df.select(bands.scale_min_max("v", ["g"])).collect()) == [0, 0, 0, 1]


def test_slope_and_aspect_of_a_plane(spark):
    df = spark.range(49).select((F.col("id") % 7).cast("int").alias("c"), F.expr("CAST(id DIV 7 AS INT)").alias("r")).withColumn("v", F.col("c") * 3.0 + F.col("r") * 4.0)
    n = raster.focal_3x3(df, "r", "c", "v").select("r", "c", raster.slope().alias("s"), raster.aspect().alias("a"), raster.position_index().alias("t"))
    inner = n.where("s IS NOT NULL").collect()
    assert len(inner) == 25 and all(math.isclose(x["s"], math.atan(5)) and abs(x["t"]) < 1e-9 for x in inner)
    flat = raster.focal_3x3(df.withColumn("v", F.lit(1.0)), "r", "c", "v").select(raster.aspect().alias("a")).where("a IS NOT NULL")
    assert {x[0] for x in flat.collect()} == {0.0}


def test_a_gap_has_no_neighbours(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0)], "r int, c int, v double")
    assert {(x["n_d"], x["n_f"]) for x in raster.focal_3x3(df, "r", "c", "v").collect()} == {(None, None)}


@pytest.mark.parametrize("how", ["nearest", "bilinear", "replicate"])
@pytest.mark.parametrize("size", [3, 4, 9])
def test_resampling_keeps_a_constant(spark, how, size):
    df = spark.range(16).select(F.lit(1).alias("k"), F.expr("CAST(id DIV 4 AS INT)").alias("r"), (F.col("id") % 4).cast("int").alias("c"), F.when(F.col("id") != 5, 7.0).alias("v"))
    got = raster.resample(df, ["k"], "r", "c", "v", (4, 4), (size, size), how).collect()
    assert all(math.isclose(x["v"], 7.0) for x in got) and (how == "nearest" or len(got) == size * size or size == 4)


def test_windows_of_small_images():
    assert grids.window_starts(100, 512, 384) == [0]
    assert grids.window_starts(1024, 512, 512) == [0, 512]
    assert grids.window_starts(1100, 512, 384) == [0, 384, 588]


def test_patch_grid_of_an_area(spark):
    box = (0.0, 0.0, 200.0, 200.0)
    assert 9 <= grids.touching(grids.grid(spark, box, 51.2), box).count() <= 16
    assert grids.grid(spark, (0.0, 0.0, 100.0, 100.0), 50.0).count() == 9  # the far side is touched


def test_patch_outside_of_the_raster_is_null(spark):
    cells = spark.range(16).select(F.expr("CAST(id DIV 4 AS INT)").alias("r"), (F.col("id") % 4).cast("int").alias("c"), F.lit(1.0).alias("v"))
    patches = spark.createDataFrame([(1, 0, 0), (2, 50, 50)], "patch_id int, py int, px int")
    got = raster.extract_windows(cells, "r", "c", "v", patches, 4, 4, 2).groupBy("patch_id").agg(F.count("v"), F.count(F.lit(1))).orderBy("patch_id").collect()
    assert [tuple(x) for x in got] == [(1, 4, 4), (2, 0, 4)]


def test_crop_and_pad(spark):
    df = spark.range(16).select(F.lit(1).alias("k"), F.expr("CAST(id DIV 4 AS INT)").alias("r"), (F.col("id") % 4).cast("int").alias("c"), F.lit(1.0).alias("v"))
    assert raster.crop_or_pad(df, ["k"], "r", "c", "v", (4, 4), 2).count() == 4
    assert one(raster.crop_or_pad(df, ["k"], "r", "c", "v", (4, 4), 6).agg(F.count(F.lit(1)), F.sum("v"))) == (36, 16.0)


def test_mosaic_is_the_same_in_any_order(spark):
    rows = [(0, 0, 1, 0.5, 1), (0, 0, 2, 0.5, 2), (0, 0, 3, 0.4, 3)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "r int, c int, code int, p double, patch int")
        assert scoring.mosaic_best(df, ["r", "c"], "code", "p", "patch").first()["code"] == 1


def test_blend_of_a_constant_and_ties(spark):
    df = spark.createDataFrame([(0, 2, 0.25, 0.5), (0, 2, 0.25, 0.25), (0, 1, 0.25, 0.5)], "x int, k int, p double, w double")
    r = scoring.blend(df, ["x"], "k", "p", "w").first()
    assert r["k"] == 1 and math.isclose(r["score"], 0.25)


def test_argmax_and_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert one(df.select(scoring.argmax("s")))[0] == 1
    assert math.isclose(sum(one(df.select(scoring.softmax("s")))[0]), 1.0)


def test_metrics_of_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (None, 1), (1, None)], "ref int, pred int")
    totals = zonal.class_totals(spark, zonal.confusion(df, "ref", "pred", 3), 3)
    iou = {r["code"]: r["iou_pct"] for r in zonal.iou_raster(totals).collect()}
    assert iou == {0: 50.0, 1: 50.0, 2: None}
    assert {r["code"]: r["iou"] for r in zonal.iou_segmentation(totals).collect()}[2] == 0
    empty = zonal.class_totals(spark, zonal.confusion(df.limit(0), "ref", "pred", 3), 3)
    assert zonal.f1_macro(empty).first()[0] == 0


def test_zonal_single_cell_has_no_deviation(spark):
    r = zonal.zonal(spark.createDataFrame([(1, 2.0)], "k int, v double"), "k", "v").first()
    assert r["v_sd"] is None and r["n"] == 1


def test_weights_sum_to_the_number_of_classes(spark):
    counts = spark.createDataFrame([(0, 10), (1, 30)], "code int, n long")
    for how in ("inverse", "balanced"):
        assert math.isclose(sum(r["weight"] for r in zonal.class_weights(spark, counts, 4, how).collect()), 4, abs_tol=1e-5)
    assert max(r["weight"] for r in zonal.class_weights(spark, counts, 4, "clamped").collect()) <= 20


def test_correction_rules(spark):
    df = spark.createDataFrame([(0, 9), (0, 14), (3, 13), (7, 13), (None, 1), (2, None), (5, 15), (4, 0)], "seg int, flair int")
    assert [r[0] for r in df.select(classes.constrained(F.col("seg"), F.col("flair"))).collect()] == [9, 3, 8, 7, 9, 2, 5, 9]
    assert [r[0] for r in df.select(classes.constrained(F.col("seg"), F.col("flair"), keep_unclassified=True)).collect()][-1] == 4


def test_forest_types(spark):
    df = spark.createDataFrame([(" ff1-49-49 ",), ("FF2G61-61",), ("LA4",), (None,)], "t string")
    assert [r[0] for r in df.select(classes.forest_type_class("t")).collect()] == [8, 4, 9, 9]


def test_dominant_label_defaults_and_ties(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0), (2, 99, 5.0)], "s int, g int, w double")
    groups = spark.createDataFrame([(10, 4), (11, 2)], "g int, code int")
    assert {r["s"]: r["code"] for r in classes.dominant_label(df, "s", "w", groups, "g").collect()} == {1: 2, 2: 0}


def test_all_cloudy_and_season_without_scene(spark):
    df = spark.createDataFrame([(1, 80, 5.0), (1, 90, 7.0)], "k int, cloud int, v double")
    assert temporal.masked_mean(df, ["k"], "v").first()["v"] == 0
    s = spark.sql("SELECT 1 AS tile_id, 7 AS scene_id, 10 AS cloud, TIMESTAMP_NTZ'2021-01-05' AS ts")
    assert temporal.top_scenes(s, (6, 9)).first()["scene_id"] == 7


def test_leap_year(spark):
    assert temporal.date_ranges(spark, [2024], (2, 2)).first()["end_date"] == "2024-02-29"


def test_touching_boxes(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 8.0, 8.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    b = spark.createDataFrame([(2, 8.0, 8.0, 9.0, 9.0)], "other int, xmin double, ymin double, xmax double, ymax double")
    assert overlay.join_boxes(a, b, 8.0, True).count() == 1 and overlay.join_boxes(a, b, 8.0, False).count() == 0


def test_ring_area_and_points(spark):
    df = spark.sql("SELECT array(struct(0D AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(0D AS x, 4D AS y)) AS ring")
    assert one(df.select(overlay.ring_area("ring"), overlay.in_ring("ring", F.lit(1.0), F.lit(1.0)), overlay.in_ring("ring", F.lit(3.0), F.lit(3.0)))) == (8.0, True, False)


def test_lowest_and_last_shape_win(spark):
    df = overlay.box_ring(spark.createDataFrame([(1, 5, 0.0, 0.0, 2.0, 2.0), (2, 7, 1.0, 0.0, 3.0, 1.0)], "id int, code int, xmin double, ymin double, xmax double, ymax double"))
    low = {(r["cx"], r["cy"]): r["code"] for r in overlay.rasterize(df, "code", 4, 2).collect()}
    last = {(r["cx"], r["cy"]): r["code"] for r in overlay.rasterize(df, "code", 4, 2, order="id").collect()}
    assert low[(1, 0)] == 5 and last[(1, 0)] == 7 and low[(3, 1)] == 9


def test_projection_of_a_known_point(spark):
    x, y = overlay.to_lambert93(F.lit(3.0), F.lit(46.5))
    assert one(spark.range(1).select(F.round(x, 3), F.round(y, 3))) == (700000.0, 6600000.0)


def test_unknown_split_is_an_error(spark):
    df = spark.createDataFrame([("val",), ("TRAIN",)], "s string")
    assert [r[0] for r in df.select(storage.normalized_split(F.col("s"))).collect()] == ["validation", "train"]
    with pytest.raises(Exception, match="unknown split"):
        spark.createDataFrame([("x",)], "s string").select(storage.normalized_split(F.col("s"))).collect()


def test_window_reads_prune_partitions(spark, tmp_path):
    df = spark.range(4096).select(F.expr("CAST(id DIV 64 AS INT)").alias("r"), (F.col("id") % 64).cast("int").alias("c"), F.lit(1.0).alias("v"))
    storage.write_raster(df, f"file://{tmp_path}/x", tile=16)
    got = storage.read_raster(spark, f"file://{tmp_path}/x", (0, 0, 3, 3), tile=16)
    assert got.count() == 16
    assert "PartitionFilters: [isnotnull(trow" in got._jdf.queryExecution().toString()


def test_failed_requests_give_null(spark):
    tiles = grids.request_tiles(spark, (0.0, 0.0, 100.0, 100.0), 1.0)
    got = services.fetch(services.map_requests(tiles, "http://x", "l"), lambda url: None, wait=lambda s: None).first()
    assert got["content"] is None and got["attempts"] == 3


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('aoi', 'geom', 2154)")
    db.execute("CREATE TABLE aoi (fid INTEGER PRIMARY KEY, geom BLOB)")
    ring = [(0, 0), (10, 0), (10, 20), (0, 20), (0, 0)]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in ring)
    db.execute("INSERT INTO aoi VALUES (1, ?)", (b"GP\x00\x01" + struct.pack("<i", 2154) + wkb,))
    db.commit()
    db.close()
    got = storage.read_geopackage(spark, f"file://{tmp_path}/a.gpkg")
    r = got.select("srs_id", F.size("ring").alias("n"), overlay.ring_area("ring").alias("area")).first()
    assert tuple(r) == (2154, 4, 200.0)
    with pytest.raises(Exception, match="no layer"):
        storage.read_geopackage(spark, f"file://{tmp_path}/a.gpkg", "none").collect()


def test_stream_grows(spark, tmp_path):
    from swathkit.streaming import arrivals

    path = str(tmp_path / "in")
    spark.sql("SELECT 1 AS user_id, TIMESTAMP_NTZ'2024-01-05' AS ts, 2D AS value UNION ALL SELECT 1, TIMESTAMP_NTZ'2024-01-25', 4D").write.parquet(path)
    assert arrivals.monthly(spark, path).first()["value"] == 3.0


def test_early_stop(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.1, 0.2, 0.2, 0.1, 0.3], 1)], "run int, epoch int, v double")
    got = scoring.early_stop(df, "run", "epoch", "v", 2).orderBy("epoch").collect()
    assert [r["waited"] for r in got] == [0, 0, 1, 2, 0] and [r["stopped"] for r in got] == [False, False, False, True, True]


_SQUARE = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
_PARTS = [[_SQUARE(0, 0, 10), _SQUARE(2, 2, 4)], [_SQUARE(20, 0, 3)]]


def _painted(df):
    """Cells in the outer rings but not in the holes of some polygons."""
    box = [f(F.col("ring")[k]).alias(k + n) for f, n in ((F.array_min, "min"), (F.array_max, "max")) for k in "xy"]
    return {(r["cx"], r["cy"]) for r in overlay.cells_in_rings(df.select("ring", "holes", *box)).collect()}


_WANTED = {(x, y) for x in range(10) for y in range(10) if not (2 <= x < 6 and 2 <= y < 6)} | {(x, y) for x in range(20, 23) for y in range(3)}


def test_geopackage_parts_and_holes(spark, tmp_path):
    polygon = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
    db = sqlite3.connect(tmp_path / "m.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('aoi', 'geom', 2154)")
    db.execute("CREATE TABLE aoi (fid INTEGER PRIMARY KEY, geom BLOB)")
    db.execute("INSERT INTO aoi VALUES (7, ?)", (b"GP\x00\x01" + struct.pack("<i", 2154) + struct.pack("<BII", 1, 6, 2) + b"".join(map(polygon, _PARTS)),))
    db.commit()
    db.close()
    got = storage.read_geopackage(spark, f"file://{tmp_path}/m.gpkg")
    assert sorted((r["fid"], r["part"], len(r["holes"])) for r in got.collect()) == [(7, 0, 1), (7, 1, 0)]
    assert _painted(got) == _WANTED


def test_features_parts_and_holes(spark):
    import json

    given = [{"type": "MultiPolygon", "coordinates": _PARTS}, {"type": "Polygon", "coordinates": _PARTS[0]}, None]
    body = json.dumps({"features": [{"properties": {"tfv": str(k)}, "geometry": g} for k, g in enumerate(given)]})
    got = services.features(spark.createDataFrame([(body,)], "body string"))
    assert sorted((r["properties"]["tfv"], r["feature"], r["part"], len(r["holes"])) for r in got.where("ring IS NOT NULL").collect()) == [("0", 0, 0, 1), ("0", 0, 1, 0), ("1", 1, 0, 1)]
    assert got.where("feature = 2 AND ring IS NULL").count() == 1
    assert _painted(got.where("feature = 0")) == _WANTED
