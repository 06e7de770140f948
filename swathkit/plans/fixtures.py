"""Views of the given tables that stand in for rasters, scenes, polygons and points; the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (base tables, Spark SELECT, DuckDB SELECT)
FIXTURES: dict[str, tuple[tuple[str, ...], str, str]] = {}


def _add(name: str, tables: tuple[str, ...], spark: str, duck: str | None = None) -> None:
    FIXTURES[name] = (tables, spark, duck or spark)


_add("fx_px", ("embeddings",),
     "SELECT vec_id AS patch_id, label AS ref_code, CAST(pos DIV 8 AS INT) AS r, CAST(pos % 8 AS INT) AS c, CAST(v AS DOUBLE) AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, v",
     "SELECT vec_id AS patch_id, label AS ref_code, CAST((i-1)//8 AS INT) AS r, CAST((i-1)%8 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1,65)) AS i FROM embeddings)")
_BANDS = (("red", 1), ("green", 17), ("blue", 33), ("nir", 49))
_add("fx_rgbi", ("embeddings",),
     "SELECT patch_id, ref_code, CAST(p DIV 4 AS INT) AS r, CAST(p % 4 AS INT) AS c, " + ", ".join(f"greatest(0D, least(255D, round(128 + 400*CAST(element_at(e, {k}+p) AS DOUBLE)))) AS {n}" for n, k in _BANDS) + " FROM (SELECT vec_id AS patch_id, label AS ref_code, embedding AS e, explode(sequence(0,15)) AS p FROM {embeddings})",
     "SELECT patch_id, ref_code, CAST(p//4 AS INT) AS r, CAST(p%4 AS INT) AS c, " + ", ".join(f"greatest(0::DOUBLE, least(255::DOUBLE, round(128 + 400*CAST(e[{k}+p] AS DOUBLE)))) AS {n}" for n, k in _BANDS) + " FROM (SELECT vec_id AS patch_id, label AS ref_code, embedding AS e, CAST(unnest(range(0,16)) AS INT) AS p FROM embeddings)")
_add("fx_cells", ("lineitem",),
     "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity=50 THEN NULL ELSE CAST(l_partkey % 10 AS INT) END AS seg, CASE WHEN l_quantity=49 THEN NULL ELSE CAST((l_suppkey + l_linenumber) % 16 AS INT) END AS flair, CAST(CASE WHEN l_returnflag='A' THEN l_partkey % 10 ELSE (l_partkey DIV 10) % 10 END AS INT) AS ref, l_extendedprice/100 AS elev FROM {lineitem}",
     "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity=50 THEN NULL ELSE CAST(l_partkey % 10 AS INT) END AS seg, CASE WHEN l_quantity=49 THEN NULL ELSE CAST((l_suppkey + l_linenumber) % 16 AS INT) END AS flair, CAST(CASE WHEN l_returnflag='A' THEN l_partkey % 10 ELSE (l_partkey // 10) % 10 END AS INT) AS ref, l_extendedprice/100 AS elev FROM lineitem")
_add("fx_scene", ("events",),
     "SELECT event_id AS scene_id, user_id AS tile_id, ts, CAST(get_json_object(props,'$.k') AS INT) AS cloud, CASE WHEN event_type IN ('view','click') THEN 'ascending' ELSE 'descending' END AS orbit, value FROM {events}",
     "SELECT event_id AS scene_id, user_id AS tile_id, ts, CAST(json_extract_string(props,'$.k') AS INT) AS cloud, CASE WHEN event_type IN ('view','click') THEN 'ascending' ELSE 'descending' END AS orbit, value FROM events")
_CATALOG = "SELECT event_id AS scene_id, user_id AS tile_id, {day} AS ts, CAST({k} AS INT) AS cloud, CASE WHEN event_type IN ('view','click') THEN 'ascending' ELSE 'descending' END AS orbit FROM "
_add("fx_catalog", ("events",),
     _CATALOG.format(day="CAST(date_add(DATE'2023-01-01', CAST((event_id * 97) % 730 AS INT)) AS TIMESTAMP_NTZ)", k="get_json_object(props,'$.k')") + "{events}",
     _CATALOG.format(day="(DATE '2023-01-01' + ((event_id * 97) % 730)::INTEGER)::TIMESTAMP", k="json_extract_string(props,'$.k')") + "events")
_TFV = "'FF1G01-01','FF1-09-09','FF1-10-10','FF2-51-51','FF2G61-61','FF2-64-64','FF2-63-63','FP','FF31',' ff1-49-49 ','LA4','FO0'"
_POLY = "SELECT p_partkey AS poly_id, CAST((p_partkey*37)%180 AS DOUBLE) AS xmin, CAST((p_partkey*53)%140 AS DOUBLE) AS ymin, CAST((p_partkey*37)%180 + 1 + p_size%12 AS DOUBLE) AS xmax, CAST((p_partkey*53)%140 + 1 + (p_size*7)%12 AS DOUBLE) AS ymax, "
_add("fx_poly", ("part",), _POLY + f"element_at(array({_TFV}), CAST(p_partkey%12+1 AS INT)) AS tfv FROM {{part}}", _POLY + f"([{_TFV}])[p_partkey%12+1] AS tfv FROM part")
_POINT = "SELECT l_suppkey AS tile_id, l_quantity - 1 AS x, CAST(l_orderkey % 50 AS DOUBLE) AS y, l_extendedprice/1000 AS z, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 5 END AS cls, l_linenumber % 4 + 1 AS return_number FROM "
_add("fx_point", ("lineitem",), _POINT + "{lineitem}", _POINT + "lineitem")
_SCAN = "SELECT l_orderkey {div} 8 AS tile_id, CAST((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 1299709 + l_orderkey * 15485863) % 50021 AS DOUBLE) / 1000 AS x, CAST((l_orderkey * 32452843 + l_linenumber * 49979687 + l_partkey * 67867967) % 49999 AS DOUBLE) / 1000 AS y, CAST(l_extendedprice AS DOUBLE) / 1000 AS z, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 5 END AS cls, l_linenumber % 4 + 1 AS return_number FROM "
_add("fx_scan", ("lineitem",), _SCAN.format(div="DIV") + "{lineitem}", _SCAN.format(div="//") + "lineitem")
_LATTICE = "SELECT floor((l_quantity - 1) / 5) * 5 + 0.0 AS x, floor((l_orderkey % 50) / 5) * 5 + 0.0 AS y, CAST(l_extendedprice AS DOUBLE) / 1000 AS z, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 5 END AS cls, l_linenumber % 4 + 1 AS return_number FROM "
_add("fx_lattice", ("lineitem",), _LATTICE + "{lineitem}", _LATTICE + "lineitem")
# Boxes, triangles, L-shapes and boxes with a hole, in and out of step with the cells.
_CORNERS = {0: "p(xmin,ymin) p(xmax,ymin) p(xmax,ymax) p(xmin,ymax)", 1: "p(xmin,ymin) p(xmax+0.25,ymin+0.125) p(xmin+0.5,ymax)", 2: "p(xmin,ymin) p(xmax,ymin) p(xmax,(ymin+ymax)/2) p((xmin+xmax)/2,(ymin+ymax)/2) p((xmin+xmax)/2,ymax) p(xmin,ymax)", 3: "p(xmin-0.5,ymin) p(xmax,ymin+0.5) p(xmax+0.5,ymax) p((xmin+xmax)/2,(ymin+ymax)/2) p(xmin,ymax-0.5)"}
_INNER = "p(xmin+(xmax-xmin)/4,ymin+(ymax-ymin)/4) p(xmin+(xmax-xmin)/4,ymax-(ymax-ymin)/4) p(xmax-(xmax-xmin)/4,ymax-(ymax-ymin)/4) p(xmax-(xmax-xmin)/4,ymin+(ymax-ymin)/4)"


def _corners(text: str, point: str, array: str) -> str:
    points = [point.format(*p[2:-1].split(",", 1)) for p in text.split(" ")]
    return array.format(", ".join(points))


def _rings(point: str, array: str, none: str) -> str:
    ring = "CASE poly_id % 4 " + " ".join(f"WHEN {k} THEN {_corners(v, point, array)}" for k, v in _CORNERS.items()) + " END AS ring"
    return f"SELECT poly_id, tfv, {ring}, CASE WHEN poly_id % 8 = 4 THEN {array.format(_corners(_INNER, point, array))} ELSE {none} END AS holes FROM "


_add("fx_ring", ("part",),
     _rings("named_struct('x', {0}, 'y', {1})", "array({0})", "CAST(array() AS array<array<struct<x: double, y: double>>>)") + f"({FIXTURES['fx_poly'][1]})",
     _rings("{{'x': {0}, 'y': {1}}}", "[{0}]", "[]") + f"({FIXTURES['fx_poly'][2]})")
_GENUS = "SELECT l_orderkey AS sample_id, CAST(l_partkey % 15 AS INT) AS genus_idx, l_quantity AS prop FROM "
_add("fx_genus", ("lineitem",), _GENUS + "{lineitem}", _GENUS + "lineitem")
_add("fx_logit", ("embeddings",),
     "SELECT vec_id AS patch_id, label AS ref_code, CAST(pos AS INT) AS class_idx, CAST(v AS DOUBLE) AS logit FROM {embeddings} LATERAL VIEW posexplode(slice(embedding,1,10)) e AS pos, v",
     "SELECT vec_id AS patch_id, label AS ref_code, CAST(i-1 AS INT) AS class_idx, CAST(embedding[i] AS DOUBLE) AS logit FROM (SELECT *, unnest(range(1,11)) AS i FROM embeddings)")
_SAMPLE = "SELECT d.doc_id AS patch_id, l.quality AS label, l.toxic AS pred, CASE WHEN d.doc_id % 20 < 14 THEN 'train' WHEN d.doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split, d.lang AS modality, CAST(d.n_chars AS DOUBLE) AS value FROM {0} d LEFT JOIN {1} l ON d.doc_id = l.doc_id"
_add("fx_sample", ("documents", "labels"), _SAMPLE.format("{documents}", "{labels}"), _SAMPLE.format("documents", "labels"))
_DOMAIN = "SELECT s_suppkey, concat('data/D', lpad(CAST(s_nationkey+1 AS {0}),3,'0'), '-', CAST(2018 + s_suppkey % 5 AS {0}), '_', CASE WHEN s_suppkey%3=0 THEN 'DEM_ELEV' ELSE 'AERIAL_RGBI' END, '.zip') AS path FROM "
_add("fx_domain", ("supplier",), _DOMAIN.format("STRING") + "{supplier}", _DOMAIN.format("VARCHAR") + "supplier")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of a data folder."""
    tables, select, _ = FIXTURES[name]
    return spark.sql(select, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_fixtures(*names: str, also: str = "") -> str:
    """The WITH clause that defines fixtures for DuckDB."""
    parts = [f"{n} AS ({FIXTURES[n][2]})" for n in names]
    return "WITH " + ", ".join(parts + ([also] if also else [])) + " "
