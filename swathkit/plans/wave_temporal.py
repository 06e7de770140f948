"""Scenes and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from .catalog import query
from .fixtures import fixture, with_fixtures

_S = with_fixtures("fx_scene")
_TOP = "own AS (SELECT *, year(ts)::INTEGER AS annee, month(ts) BETWEEN 6 AND 9 AS season FROM fx_scene WHERE cloud <= 30), pick AS (SELECT *, bool_or(season) OVER (PARTITION BY tile_id, annee) AS has FROM own), top AS (SELECT tile_id, annee, scene_id, cloud, value, row_number() OVER (PARTITION BY tile_id, annee ORDER BY cloud, scene_id)::INTEGER AS place FROM pick WHERE season OR NOT has)"


@query(_S + "SELECT scene_id, tile_id, cloud FROM fx_scene WHERE cloud <= 30")
def scene_filter_cloud(spark, d):
    return T.filter_cloud(fixture(spark, d, "fx_scene")).select("scene_id", "tile_id", "cloud").orderBy("cloud", "scene_id")


@query(_S + "SELECT scene_id, tile_id, orbit FROM fx_scene WHERE orbit = 'ascending'")
def scene_filter_orbit(spark, d):
    return T.filter_orbit(fixture(spark, d, "fx_scene"), "ASCENDING").select("scene_id", "tile_id", "orbit")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS annee FROM orders) SELECT annee, annee || '-06-01' AS start_date, annee || '-09-30' AS end_date FROM y UNION ALL SELECT annee, annee || '-01-01', last_day(make_date(annee, 2, 1))::VARCHAR FROM y")
def date_ranges(spark, d):
    """Two seasons of every year that occurs."""
    years = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("annee")).distinct()
    return T.season_ranges(years, "ete").union(T.season_ranges(years, (1, 2)))


@query(with_fixtures("fx_scene", also=_TOP) + "SELECT tile_id, annee, scene_id, cloud, place FROM top WHERE place <= 3")
def scene_topn(spark, d):
    return T.top_scenes(fixture(spark, d, "fx_scene"), (6, 9)).select("tile_id", "annee", "scene_id", "cloud", "place")


@query(_S + "SELECT tile_id, scene_id, cloud FROM fx_scene WHERE cloud IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY cloud, scene_id) = 1")
def scene_best(spark, d):
    return T.best_scenes(fixture(spark, d, "fx_scene").where("cloud IS NOT NULL"), ["tile_id"]).select("tile_id", "scene_id", "cloud")


@query(with_fixtures("fx_scene", also=_TOP) + "SELECT tile_id, annee, round(median(value), 6) AS value FROM top WHERE place <= 3 GROUP BY tile_id, annee")
def composite_median(spark, d):
    top = T.top_scenes(fixture(spark, d, "fx_scene"), (6, 9))
    return T.median_composite(top, ["tile_id", "annee"], "value").select("tile_id", "annee", F.round("value", 6).alias("value"))


@query(_S + "SELECT tile_id, round(sum(CASE WHEN cloud < 50 THEN value ELSE 0 END)/greatest(count(*) FILTER (cloud < 50), 1), 6) AS value FROM fx_scene GROUP BY tile_id")
def temporal_mean_masked(spark, d):
    return T.masked_mean(fixture(spark, d, "fx_scene"), ["tile_id"], "value").select("tile_id", F.round("value", 6).alias("value"))


@query(_S + "SELECT scene_id, 'https://example.org/' || tile_id || '/' || scene_id || '/B04' AS href FROM fx_scene WHERE cloud <= 5")
def join_scene_asset(spark, d):
    s = fixture(spark, d, "fx_scene")
    link = lambda band: F.struct(F.concat(F.lit("https://example.org/"), F.col("tile_id"), F.lit("/"), F.col("scene_id"), F.lit(f"/{band}")).alias("href"))
    assets = s.select("scene_id", F.create_map(F.lit("B04"), link("B04"), F.lit("B08"), link("B08")).alias("assets"))
    return s.where("cloud <= 5").select("scene_id").join(assets, "scene_id").select("scene_id", F.col("assets")["B04"]["href"].alias("href"))


_SPEC = "CASE s_suppkey % 3 WHEN 0 THEN concat(2015 + s_suppkey % 4, ':', 2019 + s_suppkey % 5) WHEN 1 THEN concat(2020 + s_suppkey % 4, ',', 2016 + s_suppkey % 3) ELSE concat(' ', 2018 + s_suppkey % 6, ' ') END"


@query("SELECT s_suppkey, unnest(CASE s_suppkey % 3 WHEN 0 THEN range(2015 + s_suppkey % 4, 2020 + s_suppkey % 5) WHEN 1 THEN [2020 + s_suppkey % 4, 2016 + s_suppkey % 3] ELSE [2018 + s_suppkey % 6] END)::INTEGER AS annee FROM supplier")
def parse_years(spark, d):
    """The years of written ranges and lists."""
    specs = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.expr(_SPEC).alias("spec"))
    return specs.select("s_suppkey", F.explode(T.parse_years(F.col("spec"))).alias("annee"))


@query(_S + "SELECT tile_id, count(value) AS n, round(avg(value) + 3e-8, 6) AS v_mean, round(stddev_pop(value) + 3e-8, 6) AS v_std FROM fx_scene GROUP BY tile_id")
def running_stats(spark, d):
    """Statistics of a tile from those of its days and weeks: a state that is merged as scenes arrive."""
    scenes = fixture(spark, d, "fx_scene").withColumns({"day": F.to_date("ts"), "week": F.weekofyear("ts")})
    days = T.moments(scenes, ["tile_id", "week", "day"], "value")
    whole = T.merge_moments(T.merge_moments(days, ["tile_id", "week"]), ["tile_id"])
    return whole.select("tile_id", "n", F.round(F.col("mean") + 3e-8, 6).alias("v_mean"), F.round(F.sqrt(F.col("m2") / F.col("n")) + 3e-8, 6).alias("v_std"))


@query(_S + "SELECT tile_id, date_trunc('month', ts) AS month, count(value) AS n, round(avg(value) + 3e-8, 6) AS value FROM fx_scene GROUP BY ALL HAVING count(value) > 0")
def stream_monthly_composite(spark, d):
    from ..streaming import arrivals

    found = arrivals.monthly(spark, f"{d}/events.parquet")
    return found.select("tile_id", "month", "n", F.round(F.col("value") + 3e-8, 6).alias("value"))
