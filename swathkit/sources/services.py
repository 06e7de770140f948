"""Requests to map and catalog services as tables: what to fetch is planned in Spark; the fetch itself is a small function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_name(kind: Column, vintage: Column, latest_ortho: str, latest_infrared: str) -> Column:
    """The layer of a kind of imagery (ortho, irc) and vintage; without a vintage, the latest."""
    dated = F.concat(F.when(kind == "ortho", "ORTHOIMAGERY.ORTHOPHOTOS").otherwise("ORTHOIMAGERY.ORTHOPHOTOS.IRC."), vintage.cast("string"))
    return F.when(vintage.isNull(), F.when(kind == "ortho", latest_ortho).otherwise(latest_infrared)).otherwise(dated)


def map_requests(tiles: DataFrame, endpoint: str, layer: str, crs: str = "EPSG:2154") -> DataFrame:
    """The request of every tile (idx, xmin, ymin, xmax, ymax, width, height), as ``url``."""
    fixed = urlencode({"SERVICE": "WMS", "VERSION": "1.3.0", "REQUEST": "GetMap", "LAYERS": layer, "STYLES": "", "CRS": crs, "FORMAT": "image/geotiff"})
    box = F.concat_ws(",", *[F.format_string("%.3f", c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return tiles.withColumn("url", F.concat(F.lit(f"{endpoint}?{fixed}&BBOX="), box, F.lit("&WIDTH="), F.col("width").cast("string"), F.lit("&HEIGHT="), F.col("height").cast("string")))


def fetch(requests: DataFrame, get: Callable[[str], bytes | None], retries: int = 3, wait: Callable[[float], None] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (idx, if not given), url, content, attempts: each request tried up to ``retries`` times, with waits of 2, 4, ... seconds between; null content if all fail."""
    keep = keep or ["idx"]
    kinds = dict(requests.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        pause = wait or time.sleep
        for pdf in frames:
            out = []
            for url in pdf["url"]:
                content, n = None, 0
                while content is None and n < retries:
                    n += 1
                    try:
                        content = get(url)
                    except OSError:
                        content = None
                    if content is None and n < retries:
                        pause(2.0**n)
                out.append((content, n))
            yield pd.DataFrame({**{c: pdf[c] for c in keep}, "url": pdf["url"], "content": [c for c, _ in out], "attempts": [n for _, n in out]})

    return requests.select(*keep, "url").mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "url string, content binary, attempts int"]))


def tile_cells(fetched: DataFrame, decode: Callable[[bytes], np.ndarray], keys: list[str], res: float) -> DataFrame:
    """keys, idx, r, c, v: the cells of fetched tiles, numbered from each area's upper left corner; tiles that weren't answered have none.

    ``fetched`` has keys, idx, content, the tile's x0 and y1 and its area's xmin and ymax. ``decode`` makes an array (rows,
    columns) of an answer, its first row on top.
    """
    kinds = dict(fetched.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 256):  # tiles at once
                part, found = pdf.iloc[at : at + 256], []
                for content, x0, y1, xmin, ymax in zip(part["content"], part["x0"], part["y1"], part["xmin"], part["ymax"]):
                    v = decode(content)
                    r, c = np.indices(v.shape)
                    found.append((r.ravel() + round((ymax - y1) / res), c.ravel() + round((x0 - xmin) / res), v.ravel()))
                sizes = [len(v) for _, _, v in found]
                told = {k: np.repeat(part[k].to_numpy(), sizes) for k in [*keys, "idx"]}
                yield pd.DataFrame(told | {k: np.concatenate(x) for k, x in zip("rcv", zip(*found))})

    asked = fetched.where("content IS NOT NULL").select(*keys, "idx", "content", "x0", "y1", "xmin", "ymax")
    return asked.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "idx int, r int, c int, v double"]))


def catalog_items(raw: DataFrame, column: str = "item") -> DataFrame:
    """Scenes of catalog items in JSON: id, datetime, date, cloud_cover, orbit and the address of every asset."""
    schema = "id STRING, properties STRUCT<datetime: STRING, `eo:cloud_cover`: DOUBLE, `sat:orbit_state`: STRING>, assets MAP<STRING, STRUCT<href: STRING>>"
    item = raw.select(F.from_json(column, schema).alias("i"))
    p = F.col("i.properties")
    return item.select(F.col("i.id").alias("id"), p["datetime"].alias("datetime"), F.to_date(F.substring(p["datetime"], 1, 10)).alias("date"), p["eo:cloud_cover"].alias("cloud_cover"), F.lower(p["sat:orbit_state"]).alias("orbit"), F.transform_values("i.assets", lambda k, v: v["href"]).alias("assets"))


def features(raw: DataFrame, column: str = "body") -> DataFrame:
    """properties, feature (its place in the response), part, ring (the outer one) and holes of every polygon of the features
    of vector responses in JSON; a MultiPolygon has one row for each part. Short or broken bodies give none."""
    schema = "features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    parsed = raw.where(F.length(column) >= 50).select(F.posexplode(F.from_json(column, schema)["features"]).alias("feature", "f"))
    one, given = "ARRAY<ARRAY<ARRAY<DOUBLE>>>", F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(given, f"ARRAY<{one}>")).otherwise(F.array(F.from_json(given, one)))
    rows = parsed.select(F.col("f.properties").alias("properties"), "feature", F.posexplode_outer(parts).alias("part", "rings"))
    points = lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select("properties", "feature", "part", points(F.get("rings", F.lit(0))).alias("ring"), F.transform(F.slice("rings", 2, F.greatest(F.size("rings"), F.lit(1))), points).alias("holes"))
