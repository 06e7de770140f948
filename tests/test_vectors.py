"""Triangulated heights, scanlines, the quadtree join, shapes that meet, clipping: against brute force and on hard shapes."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.operators import _clip, _delaunay, overlay, ranking, tin

POINT = "struct<x: double, y: double>"


def shapes(spark, rows):
    """id, ring, holes from (id, outline, holes)."""
    told = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    return spark.createDataFrame([(k, told(r), [told(h) for h in holes]) for k, r, holes in rows], f"id int, ring array<{POINT}>, holes array<array<{POINT}>>")


def odd(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def star(rng, x, y, size, corners):
    """A shape with dents around a centre."""
    angles = np.sort(rng.uniform(0, 2 * math.pi, corners))
    far = rng.uniform(0.3, 1.0, corners) * size
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in zip(angles, far)]


DENTED = [(0, 0), (12, 0), (12, 3), (4, 3), (4, 9), (12, 9), (12, 12), (0, 12)]
RING = ([(0, 0), (20, 0), (20, 20), (0, 20)], [[(5, 5), (5, 15), (15, 15), (15, 5)]])


# Triangulation


@pytest.mark.parametrize("kind", ["scattered", "lattice", "circle", "line and one", "narrow"])
def test_circles_are_empty(kind):
    rng = np.random.default_rng(2)
    p = {
        "scattered": lambda: rng.random((200, 2)) * 50,
        "lattice": lambda: np.stack(np.meshgrid(np.arange(12.0), np.arange(9.0)), -1).reshape(-1, 2),
        "circle": lambda: np.array([(math.cos(k / 25 * math.pi), math.sin(k / 25 * math.pi)) for k in range(50)]),
        "line and one": lambda: np.array([(k, k) for k in range(30)] + [(3, 20)], float),
        "narrow": lambda: rng.random((150, 2)) * [1000, 1e-6] + [5e5, 6e6],
    }[kind]()
    nets = []
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(p))
        net = _delaunay.Delaunay(p[order, 0], p[order, 1])
        nets.append({tuple(sorted(int(order[k]) for k in t)) for t in net.triangles()})
    assert nets[0] == nets[1] == nets[2] and nets[0]
    net = _delaunay.Delaunay(p[:, 0], p[:, 1])
    for t in net.triangles():
        assert net.turn(*t) > 0 and not any(net.inside(*t, k) for k in range(len(p)) if k not in t)
    used = {k for t in net.triangles() for k in t}
    assert used == set(range(len(p)))


def test_no_triangle_in_a_line():
    net = _delaunay.Delaunay(np.arange(5.0), 2 * np.arange(5.0))
    assert not net.after
    got = _delaunay.interpolate(np.arange(5.0), np.zeros(5), np.arange(5.0), np.array([1.2, 40.0]), np.zeros(2), 3.0, True)
    assert got[0] == 1 and np.isnan(got[1])


def _cloud(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(float(x), float(y), float(math.sin(x / 9) * 10 + y)) for x, y in np.concatenate([rng.random((n, 2)) * 60, np.stack(np.meshgrid(np.arange(60.0, 70), np.arange(10.0)), -1).reshape(-1, 2)])]
    return spark.createDataFrame(rows, "x double, y double, z double")


def test_heights_do_not_depend_on_tiles(spark):
    points = _cloud(spark).repartition(3)
    by_tile = {}
    for tile in (8.0, 20.0, 400.0):
        for fill in (False, True):
            by_tile[tile, fill] = {(r["cx"], r["cy"]): r["z"] for r in tin.area_heights(points, 1.0, tile, 5.0, fill).collect() if 0 <= r["cx"] < 75 and 0 <= r["cy"] < 65}
    assert by_tile[8.0, False] == by_tile[20.0, False] == by_tile[400.0, False] and len(by_tile[8.0, False]) > 3000
    assert {k: v for k, v in by_tile[8.0, True].items()} == by_tile[400.0, True] and len(by_tile[8.0, True]) > len(by_tile[8.0, False])


def test_heights_on_a_plane(spark):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.random((300, 2)) * 20, [[0, 0], [20, 0], [0, 20], [20, 20], [3, 3], [3, 3]]])
    rows = [("p", float(x), float(y), float(2 * x - 3 * y + 1), 2, 1) for x, y in xy]
    rows += [("few", 1.0, 1.0, 5.0, 2, 1), ("few", 2.0, 1.0, 6.0, 2, 1), ("odd", 1.0, 1.0, None, 2, 1), ("odd", float("nan"), 1.0, 1.0, 2, 1)]
    rows += [("mixed", float(x), float(y), 7.0, 5, 2) for x in (0, 20) for y in (0, 20)]
    points = spark.createDataFrame(rows, "patch string, x double, y double, z double, cls int, return_number int")
    got = tin.patch_heights(points, "patch", (0.0, 0.0, 20.0, 20.0), 5).collect()
    assert {r["patch"] for r in got} == {"p", "few", "mixed"}
    for r in got:
        if r["patch"] == "p":
            want = 2 * (r["col"] * 4 + 2) - 3 * (20 - r["row"] * 4 - 2) + 1
            assert math.isclose(r["dsm"], want, abs_tol=1e-9) and math.isclose(r["dtm"], want, abs_tol=1e-9)
        else:
            assert (r["dsm"], r["dtm"]) == ((None, None) if r["patch"] == "few" else (7.0, 7.0))
    assert {r["patch"] for r in tin.patch_heights(points, "patch", None, 5, footprint=(19.0, 21.0)).collect()} == {"p", "mixed"}
    assert tin.patch_heights(points.limit(0), "patch", None, 5).count() == 0


# Scanlines


def test_cells_equal_the_centres_inside(spark):
    rng = np.random.default_rng(1)
    rows = [(k, star(rng, *rng.uniform(10, 50, 2), rng.uniform(2, 12), int(rng.integers(3, 12))), []) for k in range(25)]
    rows += [(50, DENTED, []), (51, RING[0], RING[1]), (52, [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5)], []), (53, [(0, 0), (0.2, 0), (0.2, 0.2)], []), (51, RING[0], RING[1]), (54, [], [])]
    rows += [(55, [(-700, -3), (700, -3), (700, 3), (-700, 3)], []), (56, [(1, 1), (float("nan"), 2), (3, 1)], [])]
    got = {}
    for r in overlay.cells_in_rings(shapes(spark, rows).repartition(4)).collect():
        assert (r["cx"], r["cy"]) not in got.setdefault(r["id"], set())
        got[r["id"]].add((r["cx"], r["cy"]))
    for k, ring, holes in rows:
        if k not in (54, 56):
            reach = range(-701, 701) if k == 55 else range(-5, 75)
            assert got.get(k, set()) == {(x, y) for x in reach for y in range(-5, 75) if odd([ring, *holes], x + 0.5, y + 0.5)}
    assert not {54, 56} & set(got)


def test_scanlines_grow_with_the_outline(spark):
    big = shapes(spark, [(1, [(0, 0), (40_000, 0), (40_000, 300), (0, 300)], [])])
    spans = overlay.spans_in_rings(big)
    assert spans.count() == 300 and spans.first()["to"] == 39_999
    plan = overlay.cells_in_rings(big)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_patches_go_to_python_many_at_once(spark):
    """One call for a batch of patches, not one for each; an unknown class or return is of no kind."""
    rng = np.random.default_rng(4)
    rows = [(k % 40, *map(float, rng.uniform(0, 20, 3)), None if k % 11 == 0 else 2 + k // 40 % 2, None if k % 13 == 0 else 1 + k // 40 % 3) for k in range(1200)]
    got = tin.patch_heights(spark.createDataFrame(rows, "patch long, x double, y double, z double, cls int, return_number int"), "patch", (0.0, 0.0, 20.0, 20.0), 3)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    gx, gy = np.tile((np.arange(3) + 0.5) * (20 / 3), 3), 20 - np.repeat((np.arange(3) + 0.5) * (20 / 3), 3)
    table = {(r["patch"], r["row"], r["col"]): (r["dsm"], r["dtm"]) for r in got.collect()}
    assert len(table) == 360
    for patch in range(40):
        for j, kind in enumerate((lambda r: r[5] == 1, lambda r: r[4] == 2)):
            own = np.array(sorted(r[1:4] for r in rows if r[0] == patch and kind(r)))
            want = _delaunay.interpolate(own[:, 0], own[:, 1], own[:, 2], gx, gy, math.inf, True)
            assert all(math.isclose(table[patch, i // 3, i % 3][j], want[i]) for i in range(9))


# Pairs


def _boxes(spark, rng, n, name, crowded):
    x, y = rng.uniform(0, 500, n), rng.uniform(0, 500, n)
    x[: n // 2], y[: n // 2] = (33.0 + rng.random(n // 2), 47.0 + rng.random(n // 2)) if crowded else (x[: n // 2], y[: n // 2])
    size = rng.choice([0.0, 0.5, 3.0, 40.0, 400.0], n, p=[0.2, 0.4, 0.3, 0.08, 0.02])
    rows = [(k, float(a), float(b), float(a + s), float(b + s / 2)) for k, (a, b, s) in enumerate(zip(x, y, size))]
    return rows, spark.createDataFrame([*rows, (n, None, 0.0, 1.0, 1.0), (n + 1, 5.0, 5.0, 4.0, 6.0)], f"{name} int, xmin double, ymin double, xmax double, ymax double")


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("heavy", [40, 50_000])
def test_box_pairs_equal_all_pairs(spark, touching, heavy):
    rng = np.random.default_rng(9)
    (a_rows, a), (b_rows, b) = _boxes(spark, rng, 300, "id", True), _boxes(spark, rng, 200, "other", True)
    less = (lambda u, v: u <= v) if touching else (lambda u, v: u < v)
    want = sorted((p[0], q[0]) for p in a_rows for q in b_rows if less(p[1], q[3]) and less(q[1], p[3]) and less(p[2], q[4]) and less(q[2], p[4]))
    got = overlay.join_boxes(a, b, 2.0, touching, heavy_rows=heavy)
    assert sorted((r["id"], r["other"]) for r in got.collect()) == want and len(want) > 5000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_crowded_tile_is_split(spark):
    rows = [(k, 10.1, 10.1, 10.2, 10.2) for k in range(2000)]
    a = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    b = spark.createDataFrame(rows[:5], "other int, xmin double, ymin double, xmax double, ymax double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = overlay.join_boxes(a, b, 1.0, True, heavy_rows=100).withColumn("task", F.spark_partition_id())
        assert met.count() == 10_000 and met.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("chunk", [3, 1024])
def test_equal_boxes_are_compared_once_and_told_for_each(spark, chunk):
    rng = np.random.default_rng(12)
    boxes = [(float(x), float(y), float(x + s), float(y + s)) for x, y, s in zip(rng.integers(0, 20, 25), rng.integers(0, 20, 25), rng.choice([0, 1, 4, 9], 25))]
    rows = [(k, *boxes[k % 25]) for k in range(200)] + [(7, *boxes[0]), (None, *boxes[1]), (300, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    full = [r for r in rows if None not in r]
    want = sorted((a[0], b[0]) for a in full for b in full if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    got = overlay.overlapping_pairs(df, "id", "other", 4.0, chunk)
    assert sorted((r["id"], r["other"]) for r in got.collect()) == want and len(want) > 1000


def test_pairs_are_told_key_by_key(spark):
    df = spark.createDataFrame([(k, 0.0, 0.0, 1.0 + k % 2, 1.0) for k in range(40)], "id int, xmin double, ymin double, xmax double, ymax double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = overlay.overlapping_pairs(df, "id", "other", 4.0)
        plan = told._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    steps = dict(re.findall(r"\*\((\d+)\) Generate explode\((_keys|_o_keys)#", plan))
    assert sorted(steps.values()) == ["_keys", "_o_keys"]  # in two steps: one alone holds the product of both
    assert told.count() == 40 * 39 // 2


def test_shapes_that_meet(spark):
    mine = shapes(spark, [(1, *RING), (2, DENTED, [])])
    other = [
        (1, [(7, 7), (9, 7), (9, 8.5)], []),  # in the hole of 1, in the dent of 2
        (2, [(5, 7), (9, 7), (9, 8.5)], []),  # in the hole, touching its edge; and in the dent of 2
        (3, [(20, 20), (25, 20), (25, 25)], []),  # a corner touches a corner of 1
        (4, [(-5, -5), (40, -5), (40, 40), (-5, 40)], []),  # around both
        (5, [(1, 1), (2, 1), (2, 2)], []),  # within both
        (6, [(30, 30), (31, 30), (31, 31)], []),  # far
        (7, [(-1, 12), (30, 12), (30, 13)], []),  # along an edge of 2
    ]
    got = {(r["id"], r["other"]) for r in overlay.join_shapes(mine, shapes(spark, other).withColumnRenamed("id", "other"), 4.0).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (1, 7), (2, 4), (2, 5), (2, 7)}


def test_points_in_shapes(spark):
    rng = np.random.default_rng(3)
    spots = rng.uniform(-1, 22, (300, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "spot int, x double, y double")
    got = {(r["spot"], r["id"]) for r in overlay.join_points(points, shapes(spark, [(1, *RING), (2, DENTED, [])]), 4.0).collect()}
    assert got == {(k, i) for k, (x, y) in enumerate(spots) for i, rings in ((1, [RING[0], *RING[1]]), (2, [DENTED])) if odd(rings, x, y)}


@pytest.mark.parametrize("heavy", [20, 50_000])
def test_points_counted_in_shapes(spark, heavy):
    rng = np.random.default_rng(8)
    spots = [*rng.uniform(-1, 22, (400, 2)).tolist(), *[[float(x), float(y)] for x in range(12) for y in range(12)]]
    points = spark.createDataFrame([*spots, [None, 1.0], [float("nan"), 2.0]], "x double, y double")
    rows = [(k, *([RING, (DENTED, []), (star(rng, 9, 9, 30, 11), [])][k % 3] if k < 30 else (star(rng, *rng.uniform(0, 20, 2), 4, 7), []))) for k in range(60)] + [(99, [(90, 90), (91, 90), (91, 91)], [])]
    got = {r["id"]: r["n"] for r in overlay.count_points(points, shapes(spark, rows), "id", 4.0, heavy).collect()}
    want = {k: sum(odd([ring, *holes], x, y) for x, y in spots) for k, ring, holes in rows}
    assert got == {k: n for k, n in want.items() if n} and len(got) > 50
    pairs = overlay.join_points(points, shapes(spark, rows), 4.0).groupBy("id").count().collect()
    assert got == {r["id"]: r["count"] for r in pairs}


def test_different_shapes(spark):
    rows = [(k, *([RING, (DENTED, []), (RING[0], [])][k % 3])) for k in range(10)]
    got = overlay.different_shapes(shapes(spark, rows).withColumn("holes", F.when(F.col("id") != 2, F.col("holes"))), "rows").collect()
    assert sorted((len(r["ring"]), len(r["holes"]), r["rows"]) for r in got) == sorted([(len(RING[0]), len(RING[1]), 4), (len(DENTED), 0, 3), (len(RING[0]), 0, 3)])


# Clipping


def _raster_area(rings, clips, n=400, size=60.0):
    at = (np.arange(n) + 0.5) * size / n
    x, y = np.meshgrid(at, at)

    def inside(rings):
        out = np.zeros(x.shape, bool)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
                if ay != by:
                    out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return out

    return (inside(rings) & np.logical_or.reduce([inside(c) for c in clips])).sum() * (size / n) ** 2


def test_clipped_areas_equal_fine_rasters():
    rng = np.random.default_rng(7)
    for _ in range(25):
        mine = [star(rng, 30, 30, 25, 14), star(rng, 30, 30, 5, 6)]
        clips = [[star(rng, *rng.uniform(15, 45, 2), 25, 11)] for _ in range(3)]
        clips[0].append([(x, y) for x, y in star(rng, 30, 30, 3, 5)])
        pieces = _clip.intersection(mine, clips)
        assert abs(sum(a for _, _, a in pieces) - _raster_area(mine, clips)) < 6
        # told again: pieces are shapes of that area
        again = [[outline, *holes] for outline, holes, _ in pieces]
        assert abs(sum(_clip._area(g) for rings in again for g in rings) - sum(a for _, _, a in pieces)) < 1e-6
        assert all(_clip._area(o) > 0 and all(_clip._area(h) < 0 for h in holes) for o, holes, _ in pieces)
        assert abs(sum(_raster_area(rings, [[[(0, 0), (60, 0), (60, 60), (0, 60)]]]) for rings in again) - _raster_area(mine, clips)) < 1


def test_exact_cases():
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    sizes = lambda *given: sorted(round(a, 9) for _, _, a in _clip.intersection(*given))
    assert sizes([box(0, 0, 10, 10)], [[box(0, 0, 10, 10)]]) == [100]
    assert sizes([box(0, 0, 10, 10)], [[box(10, 0, 20, 10)]]) == [] == sizes([box(0, 0, 1, 1)], [])
    assert sizes([box(0, 0, 10, 10)], [[box(5, 0, 20, 10)], [box(0, 0, 5, 10)]]) == [100]
    (outline, holes, area), = _clip.intersection([box(0, 0, 10, 10), box(4, 4, 6, 6)], [[box(-1, -1, 11, 11)]])
    assert area == 96 and len(outline) == 4 and len(holes) == 1 and len(holes[0]) == 4
    assert sizes([box(0, 0, 10, 10)], [[box(2, -1, 4, 11)], [box(6, -1, 8, 11)]]) == [20, 20]
    assert sizes([box(0, 0, 10, 10)], [[box(0, 0, 5, 5)], [box(5, 5, 10, 10)]]) == [25, 25]
    assert sizes([DENTED], [[box(6, -1, 20, 20)]], (0, 0, 100, 6)) == [18]
    assert sizes([[]], [[box(0, 0, 1, 1)]]) == []


def test_clip_with_and_without_tiles(spark):
    rng = np.random.default_rng(11)
    rows = [(k, star(rng, *rng.uniform(5, 55, 2), rng.uniform(3, 15), 9), []) for k in range(30)] + [(90, [(200, 200), (201, 200), (201, 201)], []), (91, *RING), (91, *RING)]
    area = shapes(spark, [(1, star(rng, 30, 30, 28, 12), []), (2, [(10, 10), (50, 10), (50, 40)], [[(30, 12), (40, 12), (40, 20)]])])
    mine = shapes(spark, rows)
    whole = {r["id"]: r["a"] for r in overlay.clip(mine, area, ["id"], 8.0).groupBy("id").agg(F.sum("area").alias("a")).collect()}
    tiled = {r["id"]: r["a"] for r in overlay.clip(mine, area, ["id"], 8.0, cut=7.5).groupBy("id").agg(F.sum("area").alias("a")).collect()}
    assert 90 not in whole and 91 in whole and set(whole) == set(tiled)
    assert all(math.isclose(whole[k], tiled[k], rel_tol=1e-9) for k in whole)


# Places in an order


def test_places(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in enumerate(rng.integers(0, 40, 3000))] + [(5, 1.0)] * 900
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    got = sorted((r["place"], -r["v"], r["id"]) for r in ranking.numbered(df, [F.desc("v"), "id"]).collect())
    assert [p for p, _, _ in got] == list(range(1, len(rows) + 1)) and [(v, i) for _, v, i in got] == sorted((-v, i) for i, v in rows)
    plan = ranking.numbered(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert ranking.numbered(df.limit(0), ["v"]).count() == 0
    with pytest.raises(ValueError):
        ranking.numbered(df.withColumn("place", F.lit(1)), ["v"])
