"""Zonal statistics, metrics and class weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dims import dim, dim_sql
from ..operators import zonal as Z
from .catalog import query
from .fixtures import fixture, with_fixtures

_CELLS = with_fixtures("fx_cells")
_SAMPLE = with_fixtures("fx_sample")
_DOMAIN = with_fixtures("fx_domain")
_TOTALS = with_fixtures("fx_cells", also="ok AS (SELECT seg, ref FROM fx_cells WHERE seg IS NOT NULL AND ref IS NOT NULL), t AS (SELECT code::INTEGER AS code, (SELECT count(*) FROM ok WHERE seg=code AND ref=code) AS tp, (SELECT count(*) FROM ok WHERE ref=code) AS n_ref, (SELECT count(*) FROM ok WHERE seg=code) AS n_pred FROM range(12) k(code))")


def _totals(spark, d, n=12):
    return Z.class_totals(spark, Z.confusion(fixture(spark, d, "fx_cells"), "ref", "seg", n), n)


def _counts(spark, d):
    return fixture(spark, d, "fx_cells").where("seg IS NOT NULL").groupBy(F.col("seg").alias("code")).agg(F.count(F.lit(1)).alias("n"))


_W = with_fixtures("fx_cells", also="k AS (SELECT code::INTEGER AS code, (SELECT count(*) FROM fx_cells WHERE seg=code) AS n FROM range(12) t(code)), s AS (SELECT sum(n)::DOUBLE AS total FROM k)")


@query(with_fixtures("fx_cells", also=f"dim AS ({dim_sql('dim_ndp0')}), n AS (SELECT seg AS code, count(*) AS n_pixels FROM fx_cells WHERE seg IS NOT NULL GROUP BY seg)") + "SELECT code, n_pixels, round(n_pixels*100.0::DOUBLE/(SELECT sum(n_pixels) FROM n), 2) AS proportion, round(n_pixels*0.04::DOUBLE/10000, 4) AS surface_ha, classe, type, couleur FROM n LEFT JOIN dim USING (code)")
def landcover_stats(spark, d):
    return Z.landcover(fixture(spark, d, "fx_cells"), "seg", dim(spark, "dim_ndp0")).orderBy(F.desc("n_pixels"), "code")


@query(_CELLS + "SELECT seg AS code, round(avg(elev),1) AS v_mean, round(min(elev),1) AS v_min, round(max(elev),1) AS v_max, round(stddev_samp(elev),1) AS v_sd, count(*) AS n FROM fx_cells WHERE seg IS NOT NULL AND elev IS NOT NULL GROUP BY seg")
def zonal_dem(spark, d):
    return Z.zonal(fixture(spark, d, "fx_cells"), "seg", "elev")


@query(_CELLS + "SELECT code, q1, q2, q3, row_number() OVER (ORDER BY q2, code)::INTEGER AS place FROM (SELECT seg AS code, round(quantile_cont(elev, 0.25), 6) AS q1, round(quantile_cont(elev, 0.5), 6) AS q2, round(quantile_cont(elev, 0.75), 6) AS q3 FROM fx_cells WHERE seg <> 9 GROUP BY seg)")
def zonal_generic(spark, d):
    return Z.quartiles(fixture(spark, d, "fx_cells").where("seg <> 9"), "seg", "elev")


@query(_CELLS + "SELECT flair, round(n/sum(n) OVER (), 6) AS share FROM (SELECT flair, count(*)::DOUBLE AS n FROM fx_cells WHERE flair IS NOT NULL GROUP BY flair)")
def share_of_total(spark, d):
    n = fixture(spark, d, "fx_cells").where("flair IS NOT NULL").groupBy("flair").agg(F.count(F.lit(1)).alias("n"))
    return n.select("flair", F.round(Z.share(F.col("n")), 6).alias("share"))


@query(_CELLS + "SELECT flair, n, rank() OVER (ORDER BY n DESC)::INTEGER AS place FROM (SELECT flair, count(*) AS n FROM fx_cells WHERE flair IS NOT NULL GROUP BY flair)")
def rank_by_pixels(spark, d):
    n = fixture(spark, d, "fx_cells").where("flair IS NOT NULL").groupBy("flair").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))


@query(with_fixtures("fx_cells", also=f"dim AS ({dim_sql('dim_ndp0')})") + "SELECT type, classe, sum(n)::BIGINT AS n FROM (SELECT type, classe, 1 AS n FROM fx_cells JOIN dim ON seg = code WHERE code < 9) GROUP BY ROLLUP (type, classe)")
def type_rollup(spark, d):
    n = fixture(spark, d, "fx_cells").where("seg < 9").groupBy(F.col("seg").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(dim(spark, "dim_ndp0")), "code").rollup("type", "classe").agg(F.sum("n").alias("n"))


@query(with_fixtures("fx_cells", also="n AS (SELECT seg, count(*) AS n FROM fx_cells WHERE seg IS NOT NULL GROUP BY seg)") + "SELECT (SELECT seg FROM n WHERE seg < 9 ORDER BY n DESC, seg LIMIT 1) AS dominant, (sum(n) FILTER (seg < 9))::BIGINT AS forest, round(100.0::DOUBLE*(sum(n) FILTER (seg < 9))/sum(n), 6) AS forest_pct FROM n")
def dominant_class(spark, d):
    n = _counts(spark, d)
    forest = F.sum(F.when(F.col("code") < 9, F.col("n")))
    best = F.max(F.when(F.col("code") < 9, F.struct("n", (-F.col("code")).alias("k"))))
    return n.agg((-best["k"]).alias("dominant"), forest.alias("forest"), F.round(forest * 100.0 / F.sum("n"), 6).alias("forest_pct"))


@query(_TOTALS + "SELECT code, round(100*CASE WHEN n_ref+n_pred-tp > 0 THEN tp/(n_ref+n_pred-tp)::DOUBLE END, 2) AS iou_pct, round((SELECT sum(tp)/sum(n_ref)::DOUBLE FROM t), 6) AS accuracy, round((SELECT avg(tp/(n_ref+n_pred-tp)::DOUBLE) FROM t WHERE n_ref+n_pred-tp > 0), 6) AS m_iou FROM t")
def eval_raster(spark, d):
    return Z.iou_raster(_totals(spark, d))


@query(_CELLS + "SELECT ref, seg AS pred, count(*) AS n FROM fx_cells WHERE seg BETWEEN 0 AND 7 AND ref BETWEEN 0 AND 7 GROUP BY ALL")
def eval_confusion(spark, d):
    return Z.confusion(fixture(spark, d, "fx_cells"), "ref", "seg", 8)


@query(_TOTALS + "SELECT code, round(tp/greatest(n_ref+n_pred-tp, 1)::DOUBLE, 6) AS iou, round((SELECT avg(tp/greatest(n_ref+n_pred-tp, 1)::DOUBLE) FROM t), 6) AS m_iou FROM t")
def eval_iou_segmentation(spark, d):
    return Z.iou_segmentation(_totals(spark, d))


@query(_CELLS + "SELECT round(avg(recall), 6) AS balanced_accuracy FROM (SELECT ref, avg(coalesce((seg=ref)::INT, 0)::DOUBLE) AS recall FROM fx_cells WHERE ref IS NOT NULL GROUP BY ref)")
def eval_balanced_accuracy(spark, d):
    return Z.balanced_accuracy(fixture(spark, d, "fx_cells"), "ref", "seg")


@query(_TOTALS + "SELECT round(coalesce(avg(2*tp::DOUBLE/(n_ref+n_pred)), 0), 6) AS f1_macro FROM t WHERE tp > 0")
def eval_f1_macro(spark, d):
    return Z.f1_macro(_totals(spark, d))


@query(_CELLS + "SELECT round(100*avg((seg=ref)::INT::DOUBLE), 6) AS accuracy_pct, count(*) AS n FROM fx_cells WHERE seg IS NOT NULL AND ref IS NOT NULL")
def eval_accuracy(spark, d):
    return fixture(spark, d, "fx_cells").where("seg IS NOT NULL AND ref IS NOT NULL").agg(F.round(F.avg((F.col("seg") == F.col("ref")).cast("double")) * 100, 6).alias("accuracy_pct"), F.count(F.lit(1)).alias("n"))


@query(_CELLS + "SELECT ref AS code, count(*) FILTER (seg=ref) AS n_correct, count(*) AS n FROM fx_cells WHERE ref IS NOT NULL GROUP BY ref")
def eval_per_class(spark, d):
    return fixture(spark, d, "fx_cells").where("ref IS NOT NULL").groupBy(F.col("ref").alias("code")).agg(F.count_if(F.col("seg") == F.col("ref")).alias("n_correct"), F.count(F.lit(1)).alias("n"))


@query(_W + "SELECT code, round((1/greatest(n,1)::DOUBLE)/(SELECT sum(1/greatest(n,1)::DOUBLE) FROM k)*12, 6) AS weight FROM k")
def class_weights_inv(spark, d):
    return Z.class_weights(spark, _counts(spark, d), 12, "inverse")


@query(_W + ", b AS (SELECT code, CASE WHEN n > 0 THEN total/(12*n) ELSE 1 END AS w FROM k, s) SELECT code, round(w/(SELECT sum(w) FROM b)*12, 6) AS weight FROM b")
def class_weights_balanced(spark, d):
    return Z.class_weights(spark, _counts(spark, d), 12, "balanced")


@query(_W + "SELECT code, round(least(20.0::DOUBLE, total/(12*greatest(n,1))), 6) AS weight FROM k, s")
def class_weights_clamped(spark, d):
    return Z.class_weights(spark, _counts(spark, d), 12, "clamped")


@query(_SAMPLE + "SELECT modality, round(avg(value), 6) AS v_mean, round(sqrt(greatest(avg(value*value)-avg(value)*avg(value), 1e-12)), 4) AS v_std, count(*) AS n FROM fx_sample WHERE split='train' GROUP BY modality")
def norm_stats(spark, d):
    s = fixture(spark, d, "fx_sample").where("split = 'train'")
    return s.groupBy("modality").agg(F.round(F.avg("value"), 6).alias("v_mean"), F.round(F.sqrt(F.greatest(F.avg(F.col("value") * F.col("value")) - F.avg("value") * F.avg("value"), F.lit(1e-12))), 4).alias("v_std"), F.count(F.lit(1)).alias("n"))


@query(_CELLS + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN pct > 5 THEN 'ok' WHEN pct > 0 THEN 'weak' ELSE 'empty' END AS status FROM (SELECT l_orderkey, 100.0::DOUBLE*count(*) FILTER (seg < 2)/count(*) AS pct FROM fx_cells GROUP BY l_orderkey)) GROUP BY status")
def status_bucket(spark, d):
    pct = fixture(spark, d, "fx_cells").groupBy("l_orderkey").agg((F.count_if(F.col("seg") < 2) * 100.0 / F.count(F.lit(1))).alias("pct"))
    return pct.groupBy(F.when(F.col("pct") > 5, "ok").when(F.col("pct") > 0, "weak").otherwise("empty").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(_CELLS + "SELECT dom AS domain, count(*) AS n_patches, count(*) FILTER (labelled) AS n_labelled, count(*) FILTER (forest) AS n_forest, round(100.0::DOUBLE*count(*) FILTER (forest)/count(*), 1) AS pct FROM (SELECT l_orderkey % 20 AS dom, l_orderkey, count(seg) > 0 AS labelled, coalesce(count(*) FILTER (seg < 9)::DOUBLE/nullif(count(seg), 0), 0) > 0.05::DOUBLE AS forest FROM fx_cells GROUP BY 1, 2) GROUP BY ROLLUP (dom)")
def domain_label_stats(spark, d):
    patches = fixture(spark, d, "fx_cells").groupBy((F.col("l_orderkey") % 20).alias("domain"), "l_orderkey").agg((F.count("seg") > 0).alias("labelled"), (F.coalesce(F.count_if(F.col("seg") < 9) / F.nullif(F.count("seg"), F.lit(0)), F.lit(0.0)) > 0.05).alias("forest"))
    return patches.rollup("domain").agg(F.count(F.lit(1)).alias("n_patches"), F.count_if("labelled").alias("n_labelled"), F.count_if("forest").alias("n_forest"), F.round(F.count_if("forest") * 100.0 / F.count(F.lit(1)), 1).alias("pct"))


@query(_CELLS + "SELECT count(DISTINCT seg) AS n_seg, count(DISTINCT flair) AS n_flair FROM fx_cells")
def distinct_classes(spark, d):
    return fixture(spark, d, "fx_cells").agg(F.countDistinct("seg").alias("n_seg"), F.countDistinct("flair").alias("n_flair"))
