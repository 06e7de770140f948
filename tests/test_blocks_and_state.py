"""Rasters as blocks, exact splits and quantiles, the scene chain, moments, the stream, versions, files as rows."""

import datetime
import io
import json
import math
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.operators import blocks, grids, raster, scoring, temporal, zonal
from swathkit.plans.catalog import ORACLE_SQL, QUERIES
from swathkit.sources import services, storage
from swathkit.streaming import arrivals


def cells_of(spark, x):
    rows = [(int(r), int(c), float(x[r, c])) for r, c in np.argwhere(~np.isnan(x))]
    return spark.createDataFrame(rows, "r int, c int, v double").repartition(3)


def same(a, b):
    return np.array_equal(np.isnan(a), np.isnan(b)) and np.allclose(np.nan_to_num(a), np.nan_to_num(b), atol=1e-12)


# Blocks


def test_windows_are_cut_from_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(37, 53))
    x[rng.random(x.shape) < 0.05] = np.nan
    made = blocks.to_blocks(cells_of(spark, x), "r", "c", "v", 16)
    assert made.count() == 3 * 4
    places = [(k, int(r), int(c), int(h), int(w)) for k, (r, c, h, w) in enumerate([(0, 0, 5, 7), (10, 10, 20, 30), (-4, -6, 9, 9), (30, 45, 20, 20), (100, 100, 3, 3), (15, 31, 2, 2), (-50, 3, 60, 1)])]
    windows = spark.createDataFrame(places, "id int, r0 int, c0 int, height int, width int")
    padded = np.full((400, 400), np.nan)
    padded[100:137, 100:153] = x
    got = {r["id"]: np.array(r["data"], float) for r in blocks.cut(made, windows, 16).collect()}
    assert set(got) == set(range(len(places)))
    for k, r, c, h, w in places:
        assert same(got[k].reshape(h, w), padded[100 + r : 100 + r + h, 100 + c : 100 + c + w])
    plan = blocks.cut(made, windows, 16)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    back = {(r["r"], r["c"]): r["v"] for r in blocks.to_cells(made, 16, "r", "c", "v").where("v IS NOT NULL").collect()}
    assert back == {(int(r), int(c)): float(x[r, c]) for r, c in np.argwhere(~np.isnan(x))}


@pytest.mark.parametrize("n,m", [(16, 8), (6, 9), (5, 5)])
def test_resampled_arrays_equal_resampled_cells(spark, n, m):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, n))
    x[0, 0] = x[2, 1] = np.nan
    cells = cells_of(spark, x).withColumn("k", F.lit(1))
    want = {(r["r"], r["c"]): r["v"] for r in raster.resample(cells, ["k"], "r", "c", "v", (n, n), (m, m)).collect()}
    got = blocks.to_blocks(cells, "r", "c", "v", n).select(blocks.resampled("data", n, m).alias("d")).first()["d"]
    assert all((got[i * m + j] is None) == ((i, j) not in want) and (got[i * m + j] is None or math.isclose(got[i * m + j], want[i, j], abs_tol=1e-12)) for i in range(m) for j in range(m))


@pytest.mark.parametrize("h,w,t", [(8, 8, 11), (8, 8, 5), (4, 9, 6), (3, 3, 3)])
def test_the_middle_of_a_raster(spark, h, w, t):
    x = np.arange(1.0, h * w + 1).reshape(h, w)
    got = raster.crop_or_pad(cells_of(spark, x).withColumn("k", F.lit(1)), ["k"], "r", "c", "v", (h, w), t).collect()
    dr, dc = (h - t) // 2, (w - t) // 2
    want = {(i, j): x[i + dr, j + dc] if 0 <= i + dr < h and 0 <= j + dc < w else 0.0 for i in range(t) for j in range(t)}
    assert {(r["r"], r["c"]): r["v"] for r in got} == want


class Mean:
    asked: list = []

    def predict(self, x):
        return np.stack([x, -x, np.zeros_like(x)], 1)


def test_blended_windows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 28))
    made = blocks.to_blocks(cells_of(spark, x), "r", "c", "v", 16)
    starts = lambda n: grids.window_starts(n, 8, 4)
    windows = spark.createDataFrame([(r, c, 8, 8) for r in starts(20) for c in starts(28)], "r0 int, c0 int, height int, width int")
    found = blocks.blend_windows(blocks.cut(made, windows, 16), Mean, 8, 16, batch=5)
    total, seen, weight = np.zeros((3, 20, 28)), np.zeros((20, 28)), blocks.hann(8)
    for r in starts(20):
        for c in starts(28):
            s = np.stack([x, -x, 0 * x])[:, r : r + 8, c : c + 8]
            p = np.exp(s) / np.exp(s).sum(0)
            total[:, r : r + 8, c : c + 8] += p * weight
            seen[r : r + 8, c : c + 8] += weight
    want = (total / seen).argmax(0)
    got = blocks.to_cells(found.select("br", "bc", "code"), 16, "r", "c", "v", "code").where("v >= 0").collect()
    assert {(r["r"], r["c"]): r["v"] for r in got} == {(i, j): int(want[i, j]) for i in range(20) for j in range(28)}


def test_a_model_is_asked_by_batches(spark):
    patches = spark.createDataFrame([(k, [float(k), 1.0, -1.0, 0.5][: 4 - k % 2]) for k in range(30)], "patch_id long, data array<double>")

    class Head(scoring.LinearHead):
        def predict(self, x):
            assert x.shape[1] == 1
            return super().predict(x)

    got = scoring.predict_cells(patches, lambda: Head(np.array([[1.0], [-1.0]]), np.zeros(2)), 2, batch=7).collect()
    assert len(got) == sum(4 - k % 2 for k in range(30))
    assert all(r["code"] == (0 if {(0, 0): float(r["patch_id"]), (0, 1): 1.0, (1, 0): -1.0, (1, 1): 0.5}[r["r"], r["c"]] >= 0 else 1) for r in got)


# Exact order


@pytest.mark.parametrize("ratio", [0.0, 0.15, 0.5, 1.0])
def test_split_sizes_are_exact(spark, ratio):
    ids = [*range(0, 997, 3), *[12] * 40, None]
    df = spark.createDataFrame([(k,) for k in ids], "id long")
    got = [(r["id"], r["split"]) for r in grids.split_train_val(df, "id", ratio).collect()]
    assert sorted(i for i, _ in got if i is not None) == sorted(i for i in ids if i is not None) and (None, "train") in got
    known = [i for i in ids if i is not None]
    place = sorted(known, key=lambda i: ((i * 2654435761 + 42) % 2**32, i))[: round(len(known) * ratio)]
    assert sorted(i for i, s in got if s == "val") == sorted(place)
    plan = grids.split_train_val(df, "id", ratio)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    groups = {
        "normal": rng.normal(size=5000), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "ties": rng.integers(0, 3, 900).astype(float), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500))]),
        "close": 1.0 + rng.integers(0, 50, 400) * 2.0**-52, "extreme": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, float("inf"), float("-inf")])[:5],
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("normal", float("nan")), (None, 1.0), ("none", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r["q"] for r in zonal.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", shares).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x = np.sort(x)
        for p, q in zip(shares, got[g]):
            at = (len(x) - 1) * p
            low = math.floor(at)
            want = x[low] if at == low else (1 - (at - low)) * x[low] + (at - low) * x[low + 1]
            assert q == want or math.isclose(q, want, rel_tol=1e-12), (g, p)


# Scenes


def test_each_step_of_the_scene_chain(spark):
    day = lambda s: datetime.datetime.fromisoformat(s)
    scenes = spark.createDataFrame([
        (1, 10, day("2023-12-20"), 5), (2, 10, day("2024-01-10"), 15), (3, 10, day("2024-01-11"), 15), (4, 10, day("2024-07-01"), 1), (5, 11, day("2024-03-20"), 20), (6, 11, day("2024-08-01"), 19), (7, 11, day("2024-08-02"), 12),
        (8, 12, day("2024-02-02"), 29), (9, 12, day("2024-11-02"), 25), (10, 12, day("2024-11-03"), 31), (11, 13, day("2022-06-02"), 2), (12, 14, day("2024-05-05"), None),
    ], "scene_id long, tile_id long, ts timestamp_ntz, cloud int")
    wanted = spark.createDataFrame([(t, datetime.date(2024, 1, 15)) for t in (10, 11, 12, 13, 14)] + [(10, datetime.date(2024, 3, 30)), (11, None), (10, datetime.date(2024, 1, 15))], "tile_id long, day date")
    got = {(r["tile_id"], str(r["day"])): (r["scene_id"], r["step"]) for r in temporal.nearest_scenes(scenes, wanted).collect()}
    assert got == {(10, "2024-01-15"): (1, 1), (11, "2024-01-15"): (7, 2), (12, "2024-01-15"): (9, 3), (10, "2024-03-30"): (4, 2), (11, "None"): (7, 2)}


def test_moments_can_be_merged(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400) + 1e6
    df = spark.createDataFrame([(int(k % 3), int(k % 17), float(v) if k % 11 else None) for k, v in enumerate(x)] + [(9, 1, None)], "tile int, day int, v double")
    parts = temporal.moments(df, ["tile", "day"], "v")
    twice = temporal.merge_moments(temporal.merge_moments(parts, ["tile", "day"]), ["tile"])
    got = {r["tile"]: r for r in twice.collect()}
    assert set(got) == {0, 1, 2}
    for t in range(3):
        own = np.array([v for k, v in enumerate(x) if k % 3 == t and k % 11])
        assert got[t]["n"] == len(own) and math.isclose(got[t]["mean"], own.mean(), rel_tol=1e-12) and math.isclose(got[t]["m2"], ((own - own.mean()) ** 2).sum(), rel_tol=1e-6)


# The stream


def _arrive(spark, folder, name, rows):
    spark.createDataFrame([(t, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), v) for t, d, v in rows], "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{folder}/{name}")


def _take_in(spark, folder, table, checkpoint):
    source = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").option("recursiveFileLookup", "true").parquet(folder)
    arrivals.run(source.select(F.col("user_id").alias("tile_id"), "ts", "value"), table, checkpoint, "10 days")
    found = arrivals.closed_days(spark, table).unionByName(arrivals.open_days(spark, checkpoint))
    return {(r["tile_id"], r["day"].day): (r["n"], r["mean"]) for r in found.collect()}, arrivals.closed_days(spark, table).count()


def test_late_rows_and_restarts(spark, tmp_path):
    folder, table, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "days", "state"))
    _arrive(spark, folder, "a", [(1, 0, 2.0), (1, 0, 4.0), (1, 3, 1.0), (2, 0, None), (1, 20, 5.0)])
    days, closed = _take_in(spark, folder, table, checkpoint)
    assert days == {(1, 1): (2, 3.0), (1, 4): (1, 1.0), (2, 1): (0, None), (1, 21): (1, 5.0)} and closed == 3
    assert _take_in(spark, folder, table, checkpoint) == (days, closed)  # nothing new: nothing twice
    _arrive(spark, folder, "b", [(1, 2, 100.0), (1, 19, 7.0), (1, 20, 1.0)])  # the first is behind the watermark
    days, closed = _take_in(spark, folder, table, checkpoint)
    assert days == {(1, 1): (2, 3.0), (1, 4): (1, 1.0), (2, 1): (0, None), (1, 20): (1, 7.0), (1, 21): (2, 3.0)} and closed == 3
    _arrive(spark, folder, "c", [(3, 60, 1.0)])
    days, closed = _take_in(spark, folder, table, checkpoint)
    assert closed == 5 and days[1, 21] == (2, 3.0) and len(days) == 6
    months = {(r["tile_id"], r["month"].month): (r["n"], r["mean"]) for r in arrivals.composites(arrivals.closed_days(spark, table).unionByName(arrivals.open_days(spark, checkpoint))).collect()}
    assert months == {(1, 1): (6, 20.0 / 6), (3, 3): (1, 1.0)}


# Files


def test_torn_versions_are_ignored(spark, tmp_path):
    root = f"file://{tmp_path}/model"
    with pytest.raises(FileNotFoundError):
        storage.load_checkpoint(spark, root)
    assert storage.save_checkpoint(spark.range(3), root, {"epoch": 4, "val_acc": 0.5}) == 1
    assert storage.save_checkpoint(spark.range(5), root, {"epoch": 7}) == 2
    spark.range(9).write.parquet(f"{root}/version-00000003-torn/payload")
    payload, about = storage.load_checkpoint(spark, root)
    assert payload.count() == 5 and json.loads(about.first()[0]) == {"epoch": 7, "version": 2}
    assert storage.load_checkpoint(spark, root, 1)[0].count() == 3
    assert storage.save_checkpoint(spark.range(1), root, {}) == 4  # after the torn one
    assert storage.load_checkpoint(spark, root)[0].count() == 1


def test_geopackages_can_be_read_by_others(spark, tmp_path):
    point = "struct<x: double, y: double>"
    ring = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}]
    rows = [(k, [{"x": p["x"] + k, "y": p["y"]} for p in ring], [[{"x": 3.0 + k, "y": 1.0}, {"x": 3.5 + k, "y": 1.0}, {"x": 3.5 + k, "y": 1.5}]] if k % 2 else []) for k in range(25)]
    df = spark.createDataFrame(rows + [(99, [], [])], f"id long, ring array<{point}>, holes array<array<{point}>>")
    files = storage.geopackages(df, "id", "a \"layer\"", 4326, features=10)
    got = {r["fid"]: (r["srs_id"], [tuple(p) for p in r["ring"]], [[tuple(p) for p in h] for h in r["holes"]]) for r in storage.features_of(files).collect()}
    assert got == {k: (4326, [(p["x"], p["y"]) for p in r], [[(p["x"], p["y"]) for p in h] for h in hs]) for k, r, hs in rows}
    content = bytes(files.first()["content"])
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    assert db.execute("SELECT data_type, srs_id FROM gpkg_contents").fetchone() == ("features", 4326)
    (tmp_path / "one.gpkg").write_bytes(content)
    assert 0 < storage.read_geopackage(spark, f"file://{tmp_path}/one.gpkg").count() <= 25


def test_archives_as_rows(spark):
    df = spark.createDataFrame([("a", "x/1.txt", b"one"), ("a", "x/2.txt", b""), ("b", "y.txt", b"three")], "shelf string, entry string, data binary")
    files = storage.archives(df, "shelf", "entry", "data")
    with zipfile.ZipFile(io.BytesIO(bytes(files.where("archive = 'a'").first()["content"]))) as z:
        assert z.namelist() == ["x/1.txt", "x/2.txt"]
    broken = files.unionByName(spark.createDataFrame([("c", b"no archive")], "archive string, content binary"))
    assert {(r["archive"], r["entry"], bytes(r["content"])) for r in storage.entries_of(broken).collect()} == {("a", "x/1.txt", b"one"), ("a", "x/2.txt", b""), ("b", "y.txt", b"three")}


def test_branches_of_the_elevation_pair(spark):
    dtm = spark.createDataFrame([(k, float(k)) for k in range(20)], "c int, v double")
    rich, poor = dtm.withColumn("v", F.col("v") + 1), dtm.withColumn("v", F.when(F.col("c") == 1, 5.0))
    told = lambda df: (df.count(), {r["dsm_source"] for r in df.collect()})
    assert told(raster.elevation_pair(dtm, rich, ["c"], "v")) == (20, {"surface"})
    assert told(raster.elevation_pair(dtm, poor, ["c"], "v")) == (20, {"terrain_fallback"})
    assert told(raster.elevation_pair(dtm, poor, ["c"], "v", fallback=False)) == (0, set())
    assert told(raster.elevation_pair(dtm, None, ["c"], "v")) == (20, {"terrain_fallback"})
    assert told(raster.elevation_pair(dtm, poor, ["c"], "v", least_pct=5.0)) == (20, {"surface"})
    with pytest.raises(ValueError):
        raster.elevation_pair(dtm.limit(0), rich, ["c"], "v")


def test_failed_bands_and_tiles(spark):
    px = spark.createDataFrame([("p", r, c, float(r + c), "b1") for r in range(4) for c in range(4)], "k string, r int, c int, v double, band string")
    got = raster.stack_bands(px, ["k"], "r", "c", "v", "band", ["b1", "b2"], {"b1": 4, "b2": 2}, 4)
    assert got.columns == ["k", "r", "c", "b1"] and got.count() == 16
    with pytest.raises(ValueError):
        raster.stack_bands(px, ["k"], "r", "c", "v", "band", ["b9"], {"b9": 4}, 4)
    asked = spark.createDataFrame([("a", 1, 0.0, 2.0, 0.0, 2.0, "u1"), ("a", 2, 2.0, 2.0, 0.0, 2.0, "u2")], "area string, idx int, x0 double, y1 double, xmin double, ymax double, url string")
    answers = services.fetch(asked, lambda url: b"\x01\x02\x03\x04" if url == "u1" else None, wait=lambda s: None, keep=["area", "idx", "x0", "y1", "xmin", "ymax"])
    cells = services.tile_cells(answers, lambda b: np.frombuffer(b, np.uint8).reshape(2, 2).astype(float), ["area"], 1.0)
    assert sorted((r["r"], r["c"], r["v"]) for r in cells.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_grids_of_many_areas(spark):
    areas = spark.createDataFrame([("a", 0.0, 0.0, 100.0, 100.0), ("b", 5.0, 5.0, 5.0, 5.0), ("c", None, 0.0, 1.0, 1.0), ("d", 0.0, 0.0, 120.0, 100.3)], "k string, xmin double, ymin double, xmax double, ymax double")
    assert {r["k"]: r["count"] for r in grids.grid_over(areas, 50.0).groupBy("k").count().collect()} == {"a": 9, "b": 1, "d": 9}
    tiles = grids.request_tiles_over(areas, 0.2, 250).where("k = 'd'").orderBy("idx").collect()
    assert [(t["idx"], t["x0"], t["y0"], t["x1"]) for t in tiles] == [(1, 0.0, 0.0, 50.0), (2, 0.0, 50.0, 50.0), (3, 50.0, 0.0, 100.0), (4, 50.0, 50.0, 100.0), (5, 100.0, 0.0, 120.0), (6, 100.0, 50.0, 120.0)]
    images = spark.createDataFrame([(1, 10, 100), (2, 512, 900)], "k int, width int, height int")
    got = {}
    for r in grids.window_positions_over(images, 512, 128).collect():
        got.setdefault(r["k"], set()).add((r["x0"], r["y0"]))
    assert got == {1: {(0, 0)}, 2: {(0, y) for y in grids.window_starts(900, 512, 384)}}


def test_every_query_reads_a_table(spark, data):
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    for name in ("grid_patches", "tile_plan", "tile_degrees", "patch_positions", "hann_window", "patch_size_of", "filter_modality", "parse_patch_id", "layer_name", "date_ranges", "parse_years", "rasterize_grid", "reproject", "model_fetch", "model_match_prefix", "scan_wms_tile"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString() + str(QUERIES[name](spark, data).inputFiles())
        assert any(f"{t}.parquet" in plan for t in tables), name


def test_map_tiles_are_put_together_without_a_join(spark, data):
    """The tiles' places go along with the requests: the optimizer guessed the size of a table of tiles from that of the areas, and would broadcast it."""
    got = QUERIES["scan_wms_tiled"](spark, data)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.count() > 0


class Apart:
    def predict(self, x):
        apart = x - np.nanmean(x, 1, keepdims=True)
        return np.stack([apart, -apart], 1)


def test_missing_cells_count_for_nothing(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 12)) + 5
    known = np.ones((12, 12), bool)
    known[10:, 5:] = False  # a last row of patches that isn't full
    made = blocks.to_blocks(cells_of(spark, x).where("NOT (r >= 10 AND c >= 5)"), "r", "c", "v", 8)
    windows = spark.createDataFrame([(r, c, 8, 8) for r in (0, 4) for c in (0, 4)], "r0 int, c0 int, height int, width int")
    found = blocks.blend_windows(blocks.cut(made, windows, 8), Apart, 8, 8, missing=np.nan)
    total, weight = np.zeros((2, 12, 12)), blocks.hann(8)
    for r in (0, 4):
        for c in (0, 4):
            own = np.where(known, x, np.nan)[r : r + 8, c : c + 8]
            s = np.stack([own - np.nanmean(own), np.nanmean(own) - own])
            total[:, r : r + 8, c : c + 8] += np.exp(s) / np.exp(s).sum(0) * weight
    got = blocks.to_cells(found.select("br", "bc", "code"), 8, "r", "c", "v", "code").where("v >= 0").collect()
    assert {(r["r"], r["c"]): r["v"] for r in got} == {(i, j): int(total[:, i, j].argmax()) for i, j in zip(*map(list, np.nonzero(known)))}


def test_a_table_in_many_files_counts_once(spark, tmp_path):
    df = spark.range(30)
    df.repartition(3).write.parquet(f"{tmp_path}/tables.parquet/embeddings.parquet")
    df.toPandas().to_parquet(f"{tmp_path}/tables.parquet/documents.parquet")
    got = storage.list_tables(spark, f"{tmp_path}/tables.parquet").collect()
    assert sorted(r["path"].rsplit("/", 2)[1:] for r in got) == [["tables.parquet", "documents.parquet"], ["tables.parquet", "embeddings.parquet"]]


def test_patches_are_stacked_row_by_row(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=16).tolist(), rng.normal(size=4).tolist()) for k in range(5)]
    patches = spark.createDataFrame(rows, "k int, b1 array<double>, b2 array<double>")
    got = raster.stack_patches(patches, ["k"], "r", "c", {"b1": 4, "b2": 2}, 6)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    long = [(k, i // n, i % n, v[i], b) for k, *bands in rows for b, n, v in zip(("b1", "b2"), (4, 2), bands) for i in range(n * n)]
    want = raster.stack_bands(spark.createDataFrame(long, "k int, r int, c int, v double, band string"), ["k"], "r", "c", "v", "band", ["b1", "b2"], {"b1": 4, "b2": 2}, 6)
    table = lambda df: {(r["k"], r["r"], r["c"]): (round(r["b1"], 9), round(r["b2"], 9)) for r in df.collect()}
    assert table(got) == table(want) and len(table(got)) == 180


def test_positions_are_counted_by_sizes(spark):
    rows = [(k, 100 + 37 * (k % 3), 90 + 50 * (k % 2)) for k in range(40)] + [(1, 137, 140)]
    images = spark.createDataFrame(rows, "k int, width int, height int")
    got = grids.counted_positions(images, 64, 16)
    want = grids.window_positions_over(images, 64, 16).groupBy("x0", "y0").count()
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_files_of_a_folder_are_counted_as_glob_does(spark, duck, tmp_path):
    d, df = f"{tmp_path}/documents.parquet", spark.range(30)
    df.repartition(3).write.parquet(f"{d}/embeddings.parquet")
    for name in ("documents.parquet", "other.parquet", "embeddings.parquet.parquet", "more/documents.parquet", "more/k=1/embeddings.parquet"):
        (tmp_path / "documents.parquet" / name).parent.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_parquet(f"{d}/{name}")
    want = duck.execute(ORACLE_SQL["scan_dir"].replace("/root/testdata/sf0.01", d)).fetchall()
    for path in (d, f"{d}/", f"file:{d}", f"file://{d}"):
        assert sorted(tuple(r) for r in QUERIES["scan_dir"](spark, path).collect()) == sorted(want) == [("documents", 1)]
