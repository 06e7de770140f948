"""Grids, patches, splits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import dim, dim_sql
from ..operators import grids as G
from .catalog import query
from .fixtures import fixture, with_fixtures

_CELLS = with_fixtures("fx_cells")
_PX = with_fixtures("fx_px")
_SAMPLE = with_fixtures("fx_sample")
_DOMAIN = with_fixtures("fx_domain")
_POLY = with_fixtures("fx_poly")


def _areas(spark, d, scale, x=0.0, y=0.0):
    """Boxes of areas of interest, in metres or degrees."""
    sides = [(F.col(c) * scale + shift).alias(c) for c, shift in (("xmin", x), ("ymin", y), ("xmax", x), ("ymax", y))]
    return fixture(spark, d, "fx_poly").select("poly_id", *sides)


def _areas_sql(scale, x=0.0, y=0.0):
    sides = ", ".join(f"{c} * {scale}::DOUBLE + {shift}::DOUBLE AS {c}" for c, shift in (("xmin", x), ("ymin", y), ("xmax", x), ("ymax", y)))
    return f"aoi AS (SELECT poly_id, {sides} FROM fx_poly)"


def _cells_sql(step, size):
    n = lambda a, b: f"floor(({b} - {a}) / {step}::DOUBLE + 1e-10)::INTEGER + 1"
    return f"n AS (SELECT *, {n('xmin', 'xmax')} AS nx, {n('ymin', 'ymax')} AS ny FROM aoi), across AS (SELECT *, unnest(range(nx)) AS ix FROM n), cell AS (SELECT *, unnest(range(ny)) AS iy FROM across), placed AS (SELECT *, xmin + ix * {step}::DOUBLE AS x0, ymin + iy * {step}::DOUBLE AS y0, xmin + ix * {step}::DOUBLE + {size}::DOUBLE AS x1, ymin + iy * {step}::DOUBLE + {size}::DOUBLE AS y1 FROM cell)"


_BOXED = ", ".join(f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1"))
_METRES, _FAR = _areas_sql(40.0, 652000.0, 6812000.0), _areas_sql(200.0)


def _rounded(df, *names):
    return df.select("poly_id", *names, *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(with_fixtures("fx_poly", also=f"{_METRES}, {_cells_sql(51.2, 51.2)}") + f"SELECT poly_id, (iy * nx + ix + 1)::INTEGER AS place, {_BOXED} FROM placed")
def grid_patches(spark, d):
    """Patches over every area."""
    return _rounded(G.grid_over(_areas(spark, d, 40.0, 652000.0, 6812000.0), 51.2), "place")


@query(with_fixtures("fx_poly", also=f"{_METRES}, {_cells_sql(41.2, 51.2)}") + f"SELECT poly_id, (iy * nx + ix + 1)::INTEGER AS place, {_BOXED} FROM placed")
def grid_overlap(spark, d):
    """Patches that overlap by 10 m over every area."""
    return _rounded(G.grid_over(_areas(spark, d, 40.0, 652000.0, 6812000.0), 41.2, 51.2), "place")


_PLAN = f"{_FAR}, {_cells_sql(819.2, 819.2)}, tile AS (SELECT poly_id, ix, iy, x0, y0, least(x1, xmax) AS x1, least(y1, ymax) AS y1 FROM placed), kept AS (SELECT *, row_number() OVER (PARTITION BY poly_id ORDER BY ix, iy)::INTEGER AS idx, round((x1 - x0) / 0.2::DOUBLE)::INTEGER AS width, round((y1 - y0) / 0.2::DOUBLE)::INTEGER AS height FROM tile WHERE x1 - x0 >= 0.4::DOUBLE AND y1 - y0 >= 0.4::DOUBLE)"


@query(with_fixtures("fx_poly", also=_PLAN) + f"SELECT poly_id, idx, width, height, {_BOXED} FROM kept")
def tile_plan(spark, d):
    """Requests of at most 4,096 pixels a side over every area."""
    return _rounded(G.request_tiles_over(_areas(spark, d, 200.0), 0.2), "idx", "width", "height")


@query(with_fixtures("fx_poly", also=f"{_areas_sql(0.1, -1.0, 43.0)}, {_cells_sql(0.5, 0.5)}, tile AS (SELECT poly_id, x0, y0, least(x1, xmax) AS x1, least(y1, ymax) AS y1 FROM placed WHERE x0 < xmax AND y0 < ymax)") + f"SELECT poly_id, {_BOXED} FROM tile")
def tile_degrees(spark, d):
    """Tiles of half a degree over every area."""
    return _rounded(G.degree_tiles_over(_areas(spark, d, 0.1, -1.0, 43.0)))


_IMAGES = "image AS (SELECT poly_id, (300 + (xmax - xmin) * 150)::INTEGER AS width, (300 + (ymax - ymin) * 150)::INTEGER AS height FROM fx_poly)"
_POS = with_fixtures("fx_poly", also=f"{_IMAGES}, wide AS (SELECT *, unnest(list_distinct(range(0, greatest(width - 512, 0) + 1, 384) || [greatest(width - 512, 0)])) AS x0 FROM image), pos AS (SELECT poly_id, x0::INTEGER AS x0, unnest(list_distinct(range(0, greatest(height - 512, 0) + 1, 384) || [greatest(height - 512, 0)]))::INTEGER AS y0 FROM wide)")


def _images(spark, d):
    """Images of various sizes, some smaller than a window."""
    side = lambda a, b: (300 + (F.col(b) - F.col(a)) * 150).cast("int")
    return fixture(spark, d, "fx_poly").select("poly_id", side("xmin", "xmax").alias("width"), side("ymin", "ymax").alias("height"))


@query(_POS + "SELECT poly_id, x0, y0 FROM pos")
def patch_positions(spark, d):
    return G.window_positions_over(_images(spark, d), 512, 128).select("poly_id", "x0", "y0")


@query(_POS + "SELECT poly_id, count(*) AS n, max(x0 + 512)::INTEGER AS reach_x, max(y0 + 512)::INTEGER AS reach_y FROM pos GROUP BY poly_id")
def patch_positions_py(spark, d):
    """How many windows the blender has for each image and how far they reach; an image smaller than a window has one, too."""
    p = G.window_positions_over(_images(spark, d), 512, 128)
    return p.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x0") + 512).alias("reach_x"), F.max(F.col("y0") + 512).alias("reach_y"))


@query(_POS + "SELECT x0, y0, count(*) AS n FROM pos GROUP BY ALL")
def dedup_positions(spark, d):
    """The different window positions of all images, and how many images have each."""
    return G.counted_positions(_images(spark, d), 512, 128)


@query(with_fixtures("fx_px", also="h AS (SELECT i::INTEGER AS r, j::INTEGER AS c, greatest((0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*i/7))*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*j/7)), 1e-6) AS w FROM range(8) a(i), range(8) b(j))") + "SELECT patch_id, r, c, round(v * w, 9) AS v FROM fx_px JOIN h USING (r, c)")
def hann_window(spark, d):
    """Every patch under a window that falls off to its sides."""
    w = G.hann(spark, 8).select(F.col("i").alias("r"), F.col("j").alias("c"), "weight")
    return fixture(spark, d, "fx_px").join(F.broadcast(w), ["r", "c"]).select("patch_id", "r", "c", F.round(F.col("v") * F.col("weight"), 9).alias("v"))


_KIND = "CASE WHEN s_suppkey % 3 = 0 THEN 'dem' WHEN s_suppkey % 7 = 0 THEN 'spot' ELSE 'aerial' END"


@query(with_fixtures("fx_domain", also=f"s AS ({dim_sql('modality_specs')})") + f"SELECT s_suppkey, modality, coalesce(image_size, 256) AS px FROM (SELECT s_suppkey, {_KIND} AS modality FROM fx_domain) LEFT JOIN s USING (modality)")
def patch_size_of(spark, d):
    """The image size of each archive's modality; 256 for one that isn't known."""
    asked = fixture(spark, d, "fx_domain").select("s_suppkey", F.expr(_KIND).alias("modality"))
    return asked.join(F.broadcast(dim(spark, "modality_specs")), "modality", "left").select("s_suppkey", "modality", F.coalesce("image_size", F.lit(256)).alias("px"))


@query(_PX + "SELECT patch_id AS old_id, row_number() OVER (ORDER BY patch_id // 25, patch_id % 25)::INTEGER AS patch_id FROM (SELECT DISTINCT patch_id FROM fx_px WHERE v > 0.3::DOUBLE)")
def patch_renumber(spark, d):
    kept = fixture(spark, d, "fx_px").where("v > 0.3D").select(F.col("patch_id").alias("old_id")).distinct()
    return G.renumber(kept.withColumn("iy", F.expr("old_id DIV 25")).withColumn("ix", F.col("old_id") % 25), ["iy", "ix"]).select("old_id", "patch_id")


_HASH = "((patch_id * 2654435761 + 42) % 4294967296)"


@query(_SAMPLE + f"SELECT patch_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, patch_id) <= round_even(count(*) OVER () * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM fx_sample")
def train_val_split(spark, d):
    return G.split_train_val(fixture(spark, d, "fx_sample").select("patch_id"), "patch_id").select("patch_id", "split")


@query(_SAMPLE + f"SELECT patch_id, value FROM fx_sample ORDER BY {_HASH}, patch_id LIMIT 100")
def sample_n(spark, d):
    return G.sample_rows(fixture(spark, d, "fx_sample").select("patch_id", "value"), "patch_id", 100)


@query(_SAMPLE + "SELECT modality, patch_id FROM fx_sample QUALIFY row_number() OVER (PARTITION BY modality ORDER BY patch_id) <= 5")
def limit_per_group(spark, d):
    return G.first_per_group(fixture(spark, d, "fx_sample").select("modality", "patch_id"), ["modality"], ["patch_id"], 5)


@query(_CELLS + "SELECT l_orderkey, round(count(*) FILTER (seg < 9)::DOUBLE/count(*), 6) AS share FROM fx_cells GROUP BY 1 HAVING count(*) FILTER (seg < 9)::DOUBLE/count(*) >= 0.10::DOUBLE")
def filter_forest_pct(spark, d):
    return G.forest_share(fixture(spark, d, "fx_cells"), "l_orderkey", "seg", False).where("share >= 0.10D").withColumn("share", F.round("share", 6))


@query(_CELLS + "SELECT l_orderkey, round(count(*) FILTER (seg < 9)::DOUBLE/count(seg), 6) AS share FROM fx_cells GROUP BY 1 HAVING count(seg) > 0 AND count(*) FILTER (seg < 9)::DOUBLE/count(seg) >= 0.10::DOUBLE")
def filter_forest_pct_valid(spark, d):
    return G.forest_share(fixture(spark, d, "fx_cells"), "l_orderkey", "seg", True).where("share >= 0.10D").withColumn("share", F.round("share", 6))


@query(_CELLS + "SELECT l_orderkey, coalesce(count(*) FILTER (seg < 9)::DOUBLE/nullif(count(seg), 0), 0) > 0.05::DOUBLE AS forest FROM fx_cells GROUP BY 1")
def flag_forest_patch(spark, d):
    return G.forest_share(fixture(spark, d, "fx_cells"), "l_orderkey", "seg", True).select("l_orderkey", (F.col("share") > 0.05).alias("forest"))


@query("SELECT o_orderkey, m AS modality, place::INTEGER AS place FROM (SELECT o_orderkey, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS place FROM (SELECT o_orderkey, [x FOR x IN CASE o_orderkey % 3 WHEN 0 THEN ['dem', 'lidar', 's2'] WHEN 1 THEN ['aerial', 'dem'] ELSE ['lidar', 's1'] END IF list_contains(['s2', 'aerial', 'dem'], x)] AS m FROM orders))")
def filter_modality(spark, d):
    """For each run, the modalities asked for that are known, in the order asked for; a run may be left with none."""
    known = F.array(*[F.lit(x) for x in ("s2", "aerial", "dem")])
    asked = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('dem', 'lidar', 's2') WHEN 1 THEN array('aerial', 'dem') ELSE array('lidar', 's1') END")
    runs = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.posexplode(F.array_intersect(asked, known)).alias("p", "modality"))
    return runs.select("o_orderkey", "modality", (F.col("p") + 1).alias("place"))


@query(_DOMAIN + "SELECT s_suppkey, regexp_extract(path, '^data/(.+)_AERIAL_RGBI\\.zip$', 1) AS domain FROM fx_domain WHERE regexp_matches(path, '_AERIAL_RGBI\\.zip$')")
def filter_domain(spark, d):
    return fixture(spark, d, "fx_domain").where(F.col("path").rlike(r"_AERIAL_RGBI\.zip$")).select("s_suppkey", F.regexp_extract("path", r"^data/(.+)_AERIAL_RGBI\.zip$", 1).alias("domain"))


_DEPS = (("033", "Gironde"), ("012", "Aveyron"), ("007", "Ardeche"))


@query(_DOMAIN + "SELECT s_suppkey, dep, annee, coalesce(name, '?') AS departement FROM (SELECT s_suppkey, regexp_extract(path, 'D([0-9]{3,6})-([0-9]{4})', 1) AS dep, regexp_extract(path, 'D([0-9]{3,6})-([0-9]{4})', 2)::INTEGER AS annee FROM fx_domain) LEFT JOIN (VALUES ('033','Gironde'), ('012','Aveyron'), ('007','Ardeche')) t(k, name) ON dep = k")
def parse_domain(spark, d):
    p = fixture(spark, d, "fx_domain").select("s_suppkey", F.regexp_extract("path", "D([0-9]{3,6})-([0-9]{4})", 1).alias("dep"), F.regexp_extract("path", "D([0-9]{3,6})-([0-9]{4})", 2).cast("int").alias("annee"))
    return p.join(F.broadcast(spark.createDataFrame(_DEPS, "dep string, departement string")), "dep", "left").na.fill({"departement": "?"})


_ENTRY = "CASE p_partkey % 5 WHEN 0 THEN concat('imagery/train/TRAIN-', p_name, '_', p_partkey, '.tiff') WHEN 1 THEN concat('imagery/val/VAL-', p_partkey, '.tif') WHEN 2 THEN concat('lidar/test/', p_partkey, '.laz') WHEN 3 THEN concat('imagery/', p_partkey, '.tiff') ELSE concat('imagery/test/TEST-TRAIN-', p_partkey, '.tiff') END"


@query(f"SELECT p_partkey, CASE WHEN len(string_split(entry, '/')) = 3 AND regexp_matches(entry, '\\.tiff?$') THEN regexp_replace(regexp_replace(string_split(entry, '/')[3], '\\.tiff?$', ''), '^(TRAIN|VAL|TEST)-', '') END AS patch_id FROM (SELECT p_partkey, {_ENTRY} AS entry FROM part)")
def parse_patch_id(spark, d):
    """The patches of archive entries by name; entries of another depth or kind are of none."""
    e = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_ENTRY).alias("entry"))
    return e.select("p_partkey", G.patch_of_entry(F.col("entry"), "tiff?").alias("patch_id"))


_LAYER = "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ortho' ELSE 'irc' END AS kind, CASE WHEN s_suppkey % 3 <> 0 THEN 2018 + CAST(s_suppkey % 5 AS INT) END AS annee FROM "


@query(f"SELECT s_suppkey, CASE WHEN annee IS NULL THEN CASE kind WHEN 'ortho' THEN 'ORTHO.LATEST' ELSE 'IRC.LATEST' END ELSE CASE kind WHEN 'ortho' THEN 'ORTHOIMAGERY.ORTHOPHOTOS' ELSE 'ORTHOIMAGERY.ORTHOPHOTOS.IRC.' END || annee END AS layer FROM ({_LAYER} supplier)")
def layer_name(spark, d):
    """Names of the layers of a vintage; without one, names of the latest layers, which are parameters."""
    from ..sources.services import layer_name as name

    asked = spark.sql(_LAYER + "{supplier}", supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    return asked.select("s_suppkey", name(F.col("kind"), F.col("annee"), "ORTHO.LATEST", "IRC.LATEST").alias("layer"))


@query(_SAMPLE + "SELECT patch_id, CASE WHEN patch_id % 10 = 0 THEN 'test' WHEN patch_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM fx_sample")
def split_lookup(spark, d):
    """Listed by name with or without extension; what isn't listed is for training."""
    names = fixture(spark, d, "fx_sample").select("patch_id", F.format_string("patch_%05d.tif", "patch_id").alias("file"))
    listed = names.where("patch_id % 10 < 2").select(F.when(F.col("patch_id") % 20 < 10, F.col("file")).otherwise(F.regexp_replace("file", r"\.tif$", "")).alias("entry"), F.when(F.col("patch_id") % 10 == 0, "test").otherwise("validation").alias("split"))
    stem = listed.select(F.regexp_replace("entry", r"\.tif$", "").alias("stem"), "split")
    return names.withColumn("stem", F.regexp_replace("file", r"\.tif$", "")).join(stem, "stem", "left").select("patch_id", F.coalesce("split", F.lit("train")).alias("split"))


@query(_PX + "SELECT patch_id, round(100.0::DOUBLE*count(*) FILTER (v > 0)/count(*), 6) AS pct, 100.0::DOUBLE*count(*) FILTER (v > 0)/count(*) >= 40 AS fine FROM fx_px GROUP BY patch_id")
def validate_coverage(spark, d):
    pct = F.count_if(F.col("v") > 0) * 100.0 / F.count(F.lit(1))
    return fixture(spark, d, "fx_px").groupBy("patch_id").agg(F.round(pct, 6).alias("pct"), (pct >= 40).alias("fine"))


@query(_PX + "SELECT patch_id, round(100.0::DOUBLE*count(*) FILTER (v IS NOT NULL AND NOT isnan(v) AND v <> 0)/count(*), 6) AS pct FROM fx_px GROUP BY patch_id")
def lidar_coverage(spark, d):
    from ..operators.bands import finite

    return fixture(spark, d, "fx_px").groupBy("patch_id").agg(F.round(F.count_if(finite("v") & (F.col("v") != 0)) * 100.0 / F.count(F.lit(1)), 6).alias("pct"))


@query(with_fixtures("fx_poly") + "SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n FROM fx_poly WHERE xmax > xmin AND ymax > ymin")
def bbox_union(spark, d):
    return fixture(spark, d, "fx_poly").where("xmax > xmin AND ymax > ymin").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count(F.lit(1)).alias("n"))


@query("SELECT patch_id, v FROM (SELECT vec_id AS patch_id, label AS v FROM embeddings) WHERE patch_id IN (SELECT doc_id FROM labels)")
def join_label_exists(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("patch_id"), F.col("label").alias("v"))
    return e.join(spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("patch_id")), "patch_id", "left_semi")


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS n_known, count(*) FILTER (l.doc_id IS NULL) AS n_unknown FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_metadata(spark, d):
    entries, meta = spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id")
    known = entries.join(meta, "doc_id").agg(F.count(F.lit(1)).alias("n_known"))
    return known.join(entries.join(meta, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown")), F.lit(True))


@query("WITH m AS (SELECT vec_id // 50 AS batch, vec_id, 'aerial' AS modality FROM embeddings UNION ALL SELECT vec_id // 50, vec_id, 'dem' FROM embeddings WHERE label <> 3 OR vec_id % 100 < 50) SELECT batch, modality FROM (SELECT batch, modality, count(DISTINCT vec_id) AS n FROM m GROUP BY ALL) JOIN (SELECT vec_id // 50 AS batch, count(*) AS size FROM embeddings GROUP BY 1) USING (batch) WHERE n = size")
def join_modalities(spark, d):
    """The modalities that every row of a batch has."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.expr("vec_id DIV 50").alias("batch"))
    m = e.select("batch", "vec_id", F.lit("aerial").alias("modality")).union(e.where("label <> 3 OR vec_id % 100 < 50").select("batch", "vec_id", F.lit("dem")))
    sizes = e.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    return m.groupBy("batch", "modality").agg(F.countDistinct("vec_id").alias("n")).join(sizes, "batch").where("n = size").select("batch", "modality")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").intersect(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_diff(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").subtract(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"))


@query("SELECT s_suppkey AS id, s_nationkey AS nation, NULL::DOUBLE AS balance FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def union_tiles(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c, allowMissingColumns=True)


@query(_CELLS + "SELECT flair, n FROM (SELECT flair, count(*) AS n FROM fx_cells GROUP BY flair) ORDER BY n DESC, flair LIMIT 5")
def sort_limit(spark, d):
    return fixture(spark, d, "fx_cells").groupBy("flair").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flair").limit(5)


_KEPT = "kept AS (SELECT l_orderkey AS patch_id FROM fx_cells GROUP BY 1 HAVING {0})"


@query(with_fixtures("fx_cells", also=_KEPT.format("count(*) FILTER (seg < 9)::DOUBLE/count(*) >= 0.10::DOUBLE")) + f"SELECT patch_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, patch_id) <= round_even(count(*) OVER () * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split, 'patch_' || lpad(patch_id::VARCHAR, 5, '0') AS name FROM kept")
def train_patches(spark, d):
    kept = G.forest_share(fixture(spark, d, "fx_cells"), "l_orderkey", "seg", False).where("share >= 0.10D").select(F.col("l_orderkey").alias("patch_id"))
    return G.split_train_val(kept, "patch_id").select("patch_id", "split", F.format_string("patch_%05d", "patch_id").alias("name"))


@query(with_fixtures("fx_cells", also=_KEPT.format("count(seg) > 0 AND count(*) FILTER (seg < 9)::DOUBLE/count(seg) >= 0.10::DOUBLE AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = ''F'')".replace("''", "'")) + f", capped AS (SELECT patch_id FROM kept ORDER BY {_HASH}, patch_id LIMIT 500)") + f"SELECT patch_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, patch_id) <= round_even(count(*) OVER () * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM capped")
def train_patches_flair(spark, d):
    """Existing patches with a counterpart, forested enough, at most 500 of them (a cap that is the feature), split."""
    there = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = G.forest_share(fixture(spark, d, "fx_cells").join(there, "l_orderkey", "left_semi"), "l_orderkey", "seg", True).where("share >= 0.10D")
    return G.split_train_val(G.sample_rows(kept.select(F.col("l_orderkey").alias("patch_id")), "patch_id", 500), "patch_id").select("patch_id", "split")
