"""Class tables and class algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import BROADLEAF, CONIFER, DIMS, GENUS_GROUPS, LANDCOVER_LUT, TFV_PREFIXES, dim, dim_sql
from ..operators import classes as C
from .catalog import query
from .fixtures import fixture, with_fixtures

for _name in DIMS:
    query(dim_sql(_name), name=_name)(lambda spark, d, name=_name: dim(spark, name))

_CELLS = with_fixtures("fx_cells")
_POLY = with_fixtures("fx_poly")
_TFV_SQL = "CASE " + " ".join(f"WHEN starts_with(upper(trim(tfv)), '{p}') THEN {k}" for k, ps in TFV_PREFIXES.items() for p in ps) + " ELSE 9 END"
_CONSTRAIN = f"CASE WHEN flair IS NOT NULL AND flair NOT IN (13,14,15) THEN 9 WHEN flair=14 AND seg IN {BROADLEAF} THEN 3 WHEN flair=13 AND seg IN {CONIFER} THEN 8 ELSE seg END"


def _groups(spark):
    genera = [(i, g) for i, g, _ in DIMS["dim_genera"][1]]
    return spark.createDataFrame([(i, GENUS_GROUPS[g]) for i, g in genera if g in GENUS_GROUPS], "genus_idx int, code int")


_GROUPS_SQL = "(VALUES " + ", ".join(f"({i}, {GENUS_GROUPS[g]})" for i, g, _ in DIMS["dim_genera"][1] if g in GENUS_GROUPS) + ") g(genus_idx, code)"


@query(with_fixtures("fx_cells", also=f"dim AS ({dim_sql('dim_ndp0')})") + "SELECT seg AS code, n, classe, type FROM (SELECT seg, count(*) AS n FROM fx_cells GROUP BY seg) LEFT JOIN dim ON seg = code")
def join_class(spark, d):
    n = fixture(spark, d, "fx_cells").groupBy(F.col("seg").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return C.join_class(n, dim(spark, "dim_ndp0")).select("code", "n", "classe", "type")


@query(_POLY + f"SELECT poly_id, {_TFV_SQL} AS code FROM fx_poly")
def reclass_tfv(spark, d):
    return fixture(spark, d, "fx_poly").select("poly_id", C.forest_type_class("tfv").alias("code"))


@query(_POLY + f"SELECT {_TFV_SQL} AS code, count(*) AS n FROM fx_poly GROUP BY 1")
def join_regex(spark, d):
    """The same by an equi-join on the code's first characters: one row a prefix, prefixes of one length at a time."""
    p = fixture(spark, d, "fx_poly").withColumn("tidy", F.upper(F.trim("tfv")))
    out = p.withColumn("code", F.lit(None).cast("int"))
    for size in sorted({len(x) for ps in TFV_PREFIXES.values() for x in ps}):
        table = spark.createDataFrame([(x, k) for k, ps in TFV_PREFIXES.items() for x in ps if len(x) == size], "prefix string, found int")
        out = out.withColumn("prefix", F.substring("tidy", 1, size)).join(F.broadcast(table), "prefix", "left").withColumn("code", F.coalesce("code", "found")).drop("prefix", "found")
    return out.na.fill({"code": 9}).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(with_fixtures("fx_logit") + f"SELECT patch_id, class_idx, ({list(LANDCOVER_LUT)})[class_idx+1]::INTEGER AS code FROM fx_logit")
def reclass_flair_cosia(spark, d):
    return fixture(spark, d, "fx_logit").select("patch_id", "class_idx", C.landcover_code("class_idx").alias("code"))


@query(_CELLS + "SELECT code, dense_rank() OVER (ORDER BY code)::INTEGER AS position FROM (SELECT DISTINCT flair AS code FROM fx_cells WHERE flair IS NOT NULL AND flair % 3 <> 1)")
def reclass_present(spark, d):
    return C.reindex_present(fixture(spark, d, "fx_cells").where("flair % 3 <> 1").select(F.col("flair").alias("code")), "code")


@query(with_fixtures("fx_genus", also=f"g AS ({dim_sql('dim_genera')})") + "SELECT code, count(*) AS n FROM fx_genus JOIN g ON idx = genus_idx GROUP BY code")
def reclass_genus(spark, d):
    genera = dim(spark, "dim_genera").select(F.col("idx").alias("genus_idx"), "code")
    return fixture(spark, d, "fx_genus").join(F.broadcast(genera), "genus_idx").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(with_fixtures("fx_genus") + f"SELECT sample_id, coalesce(code, 0) AS code FROM (SELECT DISTINCT sample_id FROM fx_genus) LEFT JOIN (SELECT sample_id, code FROM (SELECT sample_id, code, row_number() OVER (PARTITION BY sample_id ORDER BY sum(prop) DESC, code) AS k FROM fx_genus JOIN {_GROUPS_SQL} USING (genus_idx) GROUP BY sample_id, code) WHERE k = 1) USING (sample_id)")
def dominant_genus(spark, d):
    return C.dominant_label(fixture(spark, d, "fx_genus"), "sample_id", "prop", _groups(spark), "genus_idx")


@query(_CELLS + f"SELECT l_orderkey, l_linenumber, seg, flair, {_CONSTRAIN} AS corrected FROM fx_cells")
def constrain_classes(spark, d):
    return fixture(spark, d, "fx_cells").select("l_orderkey", "l_linenumber", "seg", "flair", C.constrained(F.col("seg"), F.col("flair")).alias("corrected"))


@query(with_fixtures("fx_cells", also=f"k AS (SELECT count(*) AS valid, count(*) FILTER (flair NOT IN (13,14,15) AND seg <> 9) AS a, count(*) FILTER (flair=14 AND seg IN {BROADLEAF}) AS b, count(*) FILTER (flair=13 AND seg IN {CONIFER}) AS c, count(*) FILTER (flair=0) AS u FROM fx_cells WHERE seg IS NOT NULL AND flair IS NOT NULL)")
       + "SELECT item, n, round(100.0::DOUBLE*n/valid, 2) AS pct FROM (SELECT valid, unnest(['valid','non_forest','conifer','broadleaf','unclassified','unchanged']) AS item, unnest([valid,a,b,c,u,valid-a-b-c]) AS n FROM k)")
def constrain_stats(spark, d):
    return C.constraint_report(fixture(spark, d, "fx_cells"))


@query(with_fixtures("fx_rgbi", also="i AS (SELECT *, (nir-red)/(nir+red+1e-8) AS ndvi, (red+green+blue)/3 AS br FROM fx_rgbi)") + "SELECT patch_id, r, c, CASE WHEN ndvi < -0.1::DOUBLE THEN 7 WHEN ndvi > 0.1::DOUBLE THEN 10 WHEN br <= 100 THEN 6 ELSE 4 END AS code FROM i")
def spectral_classify(spark, d):
    return fixture(spark, d, "fx_rgbi").select("patch_id", "r", "c", C.spectral_class(*map(F.col, ("red", "green", "blue", "nir"))).alias("code"))


@query(_POLY + f"SELECT tfv_code AS code, count(*) AS n FROM (SELECT {_TFV_SQL} AS tfv_code FROM fx_poly) GROUP BY 1")
def class_counts(spark, d):
    return fixture(spark, d, "fx_poly").groupBy(C.forest_type_class("tfv").alias("code")).agg(F.count(F.lit(1)).alias("n"))
