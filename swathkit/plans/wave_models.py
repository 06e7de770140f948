"""The model boundary."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks as K
from ..operators import grids as G
from ..operators import scoring as S
from .catalog import query
from .fixtures import fixture, with_fixtures

_L = with_fixtures("fx_logit")
_PX = with_fixtures("fx_px")
WEIGHTS = [[((k * 7 + i * 3) % 11 - 5) / 10 for i in range(64)] for k in range(4)]
BIAS = [0.05, -0.02, 0.0, 0.01]


def _scores(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("patch_id"), F.slice("embedding", 1, 10).cast("array<double>").alias("s"), F.col("embedding").cast("array<double>").alias("data"), "label")


def _head():
    return S.LinearHead(np.array(WEIGHTS), np.array(BIAS))


@query(_L + "SELECT patch_id, class_idx AS code FROM fx_logit QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY logit DESC, class_idx) = 1")
def argmax_class(spark, d):
    return _scores(spark, d).select("patch_id", S.argmax("s").alias("code"))


@query(_L + "SELECT patch_id, class_idx, round(exp(logit - max(logit) OVER w)/sum(exp(logit)) OVER w*exp(max(logit) OVER w), 6) AS p FROM fx_logit WINDOW w AS (PARTITION BY patch_id)")
def softmax(spark, d):
    return _scores(spark, d).select("patch_id", F.posexplode(S.softmax("s")).alias("class_idx", "p")).select("patch_id", "class_idx", F.round("p", 6).alias("p"))


@query(_PX + "SELECT patch_id, c, round(avg(v), 6) AS v FROM fx_px GROUP BY ALL")
def mean_pool(spark, d):
    return fixture(spark, d, "fx_px").groupBy("patch_id", "c").agg(F.round(F.avg("v"), 6).alias("v"))


_HEAD_SQL = "w AS (SELECT k::INTEGER AS k, i::INTEGER AS i, ((k*7+i*3) % 11 - 5)/10.0::DOUBLE AS w FROM range(4) a(k), range(64) b(i)), s AS (SELECT patch_id, k, sum(v*w) + ([0.05, -0.02, 0.0, 0.01])[k+1]::DOUBLE AS score FROM fx_px JOIN w ON i = r*8+c GROUP BY patch_id, k)"


@query(with_fixtures("fx_px", also=_HEAD_SQL) + "SELECT patch_id, k AS class_idx, round(score, 6) AS score FROM s")
def linear_head(spark, d):
    return _scores(spark, d).select("patch_id", F.posexplode(S.linear_head(F.col("data"), WEIGHTS, BIAS)).alias("class_idx", "score")).select("patch_id", "class_idx", F.round("score", 6).alias("score"))


_INFER = with_fixtures("fx_px", also=_HEAD_SQL) + "SELECT patch_id, k AS code, round(1/(SELECT sum(exp(x.score - s.score)) FROM s x WHERE x.patch_id = s.patch_id), 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY s.score DESC, k) = 1"


@query(_INFER)
def infer_patch(spark, d):
    return S.predict_patches(_scores(spark, d), _head).select("patch_id", "code", F.round("score", 6).alias("score"))


@query(_INFER)
def infer_patch_multimodal(spark, d):
    """Two halves of each vector as two modalities, and a third that only some patches have, which is left out."""
    s = _scores(spark, d)
    m = s.select("patch_id", F.lit("a").alias("modality"), F.slice("data", 1, 32).alias("data")).union(s.select("patch_id", F.lit("b"), F.slice("data", 33, 32))).union(s.where("label = 3").select("patch_id", F.lit("c"), F.slice("data", 1, 4)))
    return S.predict_multimodal(m, _head).select("patch_id", "code", F.round("score", 6).alias("score"))


_CELL_SQL = "z AS (SELECT patch_id, r, c, v, [v*1.0, v*-0.5+0.02, 0.01::DOUBLE] AS s FROM fx_px), y AS (SELECT patch_id, r, c, s, list_max(s) AS top FROM z), x AS (SELECT patch_id, r, c, (list_position(s, top)-1)::INTEGER AS code, 1/(exp(s[1]-top)+exp(s[2]-top)+exp(s[3]-top)) AS p FROM y)"


def _cell_head():
    return S.LinearHead(np.array([[1.0], [-0.5], [0.0]]), np.array([0.0, 0.02, 0.01]))


def _class_maps(spark, d):
    return S.predict_cells(_scores(spark, d), _cell_head, 8)


@query(with_fixtures("fx_px", also=_CELL_SQL) + "SELECT patch_id, r, c, code, round(p, 6) AS p FROM x")
def infer_segment(spark, d):
    return _class_maps(spark, d).select("patch_id", "r", "c", "code", F.round("p", 6).alias("p"))


def _windows():
    """Overlapping windows: patch k starts at column 4 k of one long strip."""
    return (F.col("patch_id") * 4 + F.col("c")).alias("gc")


@query(with_fixtures("fx_px", also=_CELL_SQL) + "SELECT r, patch_id*4+c AS gc, code, round(p, 6) AS p FROM x QUALIFY row_number() OVER (PARTITION BY r, patch_id*4+c ORDER BY p DESC, patch_id) = 1")
def mosaic_maxproba(spark, d):
    cells = _class_maps(spark, d).select("patch_id", "r", _windows(), "code", "p")
    return S.mosaic_best(cells, ["r", "gc"], "code", "p", "patch_id").select("r", "gc", "code", F.round("p", 6).alias("p"))


_BLEND = "b AS (SELECT r, patch_id*4+c AS gc, k::INTEGER AS k, s[k+1] AS p, greatest((0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*r/7))*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*c/7)), 1e-6) AS w FROM z, range(3) t(k)), bb AS (SELECT r, gc, k, sum(p*w)/greatest(sum(w), 1e-8) AS score FROM b GROUP BY ALL)"


@query(with_fixtures("fx_px", also=f"{_CELL_SQL}, {_BLEND}") + "SELECT r, gc, k, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY r, gc ORDER BY score DESC, k) AS n FROM bb) WHERE n = 1")
def blend_hann(spark, d):
    px = fixture(spark, d, "fx_px")
    scores = px.select("patch_id", "r", "c", F.posexplode(F.array(F.col("v") * 1.0, F.col("v") * -0.5 + 0.02, F.lit(0.01))).alias("k", "p"))
    w = G.hann(spark, 8).select(F.col("i").alias("r"), F.col("j").alias("c"), F.col("weight").alias("w"))
    cells = scores.join(F.broadcast(w), ["r", "c"]).select("r", _windows(), "k", "p", "w")
    return S.blend(cells, ["r", "gc"], "k", "p", "w").select("r", "gc", "k", F.round("score", 6).alias("score"))


class ContrastHead:
    """Scores of cells from how they differ from the mean of their window's known cells."""

    def predict(self, patches):
        known = ~np.isnan(patches)
        apart = patches - np.where(known, patches, 0.0).sum(1, keepdims=True) / np.maximum(known.sum(1, keepdims=True), 1)
        return np.stack([apart, -0.5 * apart + 0.02, np.full_like(apart, 0.01)], 1)


_FLAIR = """m AS (SELECT ((patch_id // 25)*8 + r)::INTEGER AS r, ((patch_id % 25)*8 + c)::INTEGER AS c, v FROM fx_px), side AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM m),
win AS (SELECT * FROM (SELECT DISTINCT unnest(list_append(range(0, h - 15, 8), h - 16)) AS y0 FROM side), (SELECT DISTINCT unnest(list_append(range(0, w - 15, 8), w - 16)) AS x0 FROM side)),
px AS (SELECT r, c, r - y0 AS i, c - x0 AS j, v - avg(v) OVER (PARTITION BY y0, x0) AS v FROM win JOIN m ON r BETWEEN y0 AND y0 + 15 AND c BETWEEN x0 AND x0 + 15),
s AS (SELECT *, [v, -0.5::DOUBLE * v + 0.02::DOUBLE, 0.01::DOUBLE] AS s, greatest((0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*i/15))*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*j/15)), 1e-6) AS wt FROM px),
p AS (SELECT r, c, wt, k::INTEGER AS k, exp(s[k + 1]) / (exp(s[1]) + exp(s[2]) + exp(s[3])) AS p FROM s, range(3) t(k)),
mean AS (SELECT r, c, k, sum(p * wt) / sum(wt) AS score FROM p GROUP BY ALL)"""


@query(with_fixtures("fx_px", also=_FLAIR) + "SELECT r, c, ([1, 5, 4])[k + 1]::INTEGER AS code, round(score, 6) AS score FROM mean QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY score DESC, k) = 1")
def infer_flair(spark, d):
    """A whole raster in overlapping windows, blended block by block: windows are cut out of blocks, scored in batches, and their codes read."""
    from ..operators.classes import landcover_code

    cells = fixture(spark, d, "fx_px").select(F.expr("CAST((patch_id DIV 25)*8 + r AS INT)").alias("r"), F.expr("CAST((patch_id % 25)*8 + c AS INT)").alias("c"), "v")
    height, width = cells.agg(F.max("r") + 1, F.max("c") + 1).first()
    blocks = K.to_blocks(cells, "r", "c", "v", 64)
    places = G.window_positions(spark, width, height, 16, 8).select(F.col("y0").alias("r0"), F.col("x0").alias("c0"), F.lit(16).alias("height"), F.lit(16).alias("width"))
    found = K.blend_windows(K.cut(blocks, places, 64), ContrastHead, 16, 64, missing=np.nan)
    told = found.select("br", "bc", F.arrays_zip("code", "score").alias("data"))
    long = K.to_cells(told, 64, "r", "c", "x").where("x.code >= 0")
    return long.select("r", "c", landcover_code("x.code").alias("code"), F.round("x.score", 6).alias("score"))


_EPOCHS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS epoch, value FROM events), f AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e), g AS (SELECT *, best IS NULL OR value > best AS improved FROM f), h AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM g)"


@query(f"WITH {_EPOCHS} SELECT user_id, epoch, improved, waited, max(waited) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) >= 15 AS stopped FROM h")
def early_stop(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("epoch"), "value")
    return S.early_stop(e, "user_id", "epoch", "value", 15).select("user_id", "epoch", "improved", "waited", "stopped")


@query("SELECT vec_id AS patch_id, label AS code, doc_id IS NOT NULL AS known FROM embeddings LEFT JOIN labels ON vec_id = doc_id")
def join_prediction(spark, d):
    grid = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("patch_id"), F.col("label").alias("code"))
    pred = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("patch_id"), F.lit(True).alias("known"))
    return grid.join(pred, "patch_id", "left").na.fill({"known": False})


_NAMES = "SELECT s_suppkey, concat(CASE s_suppkey % 4 WHEN 0 THEN 'model.' WHEN 3 THEN 'module.' ELSE 'model.seg.' END, 'layer.', s_suppkey) AS name FROM "


@query(f"WITH n AS ({_NAMES} supplier), w AS (SELECT 'layer.' || s_suppkey AS name FROM supplier WHERE s_acctbal > 0), p AS (SELECT * FROM (VALUES (0, ''), (1, 'model.'), (2, 'module.'), (3, 'model.seg.')) t(place, prefix)) SELECT prefix, count(*) AS n FROM n JOIN p ON starts_with(n.name, prefix) JOIN w ON w.name = substr(n.name, length(prefix) + 1) GROUP BY place, prefix ORDER BY n DESC, place LIMIT 1")
def model_match_prefix(spark, d):
    """The prefix under which most of a checkpoint's names are those of the model."""
    suppliers = spark.read.parquet(f"{d}/supplier.parquet")
    names = spark.sql(_NAMES + "{supplier}", supplier=suppliers).select("name")
    wanted = suppliers.where("s_acctbal > 0").select(F.concat(F.lit("layer."), "s_suppkey").alias("name"))
    return S.best_prefix(names, wanted, ["", "model.", "module.", "model.seg."])


_FILES = "SELECT concat('model-', s_nationkey) AS model, concat('weights-', s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '.safetensors' WHEN 1 THEN '.bin' WHEN 2 THEN '.pt' WHEN 3 THEN '.pth' WHEN 4 THEN '.ckpt' ELSE '.md' END) AS file FROM "


@query(f"SELECT model, file FROM (SELECT model, file, list_position(['ckpt', 'pth', 'pt', 'bin', 'safetensors'], string_split(file, '.')[-1]) AS place FROM ({_FILES} supplier)) WHERE place > 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY place, file) = 1")
def model_fetch(spark, d):
    """Of the files of every model, the weights of the best format; models without weights have none."""
    return S.best_file(spark.sql(_FILES + "{supplier}", supplier=spark.read.parquet(f"{d}/supplier.parquet")))
