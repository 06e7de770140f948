"""Rasters, patches and results in files: partitioned Parquet with range filters, archives, indexes, folders."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or the context's, which all machines share; only a local master
    (tests) gets a temporary one where both are unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="swathkit-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read from there: what is read more than once is made once, and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_raster(df: DataFrame, path: str, row: str = "r", col: str = "c", tile: int = 256) -> None:
    """Cells in Parquet, in folders by tile row, sorted in files, so that a window reads few row groups."""
    tiled = df.withColumn("trow", F.expr(f"CAST({row} DIV {tile} AS INT)"))
    tiled.repartition("trow").sortWithinPartitions(row, col).write.mode("overwrite").partitionBy("trow").parquet(path, compression="zstd")


def read_raster(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None, buffer: int = 0, row: str = "r", col: str = "c", tile: int = 256) -> DataFrame:
    """Cells of a raster; with a box (first row, first column, last row, last column), those within it and a buffer, by pushed filters."""
    df = spark.read.parquet(path)
    if box is None:
        return df.drop("trow")
    r0, c0, r1, c1 = box[0] - buffer, box[1] - buffer, box[2] + buffer, box[3] + buffer
    return df.where(F.col("trow").between(r0 // tile, r1 // tile) & F.col(row).between(r0, r1) & F.col(col).between(c0, c1)).drop("trow")


def list_files(spark: SparkSession, path: str, pattern: str = "*.tif", below: bool = True) -> DataFrame:
    """path, modified, length of all files below a folder, or only of those directly in it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    if not below:  # Spark may write the scheme of a path in another way, so it is left out
        files = files.where(F.endswith(F.regexp_replace("path", "/[^/]*$", ""), F.lit(re.sub(r"^[\w+.-]+:(//[^/]*)?(?=/)", "", path).rstrip("/"))))
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def list_tables(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """path of all tables below a folder: a file of that suffix, or a folder of it, however many files it holds."""
    files = list_files(spark, path, "*" + suffix).select(F.substring_index(F.col("path"), path.rstrip("/") + "/", -1).alias("_rest"))
    return files.select(F.concat(F.lit(path.rstrip("/") + "/"), F.regexp_replace("_rest", f"({re.escape(suffix)})/.*$", "$1")).alias("path")).distinct()


def count_by_modality(files: DataFrame, suffixes: DataFrame, at_end: bool = False) -> DataFrame:
    """modality, n of files whose path holds the modality's suffix, or ends with it; modalities without a file are left out."""
    return files.join(F.broadcast(suffixes), (F.endswith if at_end else F.contains)(F.col("path"), F.col("suffix"))).groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


def archives(df: DataFrame, archive: str, entry: str, content: str) -> DataFrame:
    """archive, content: the rows of each archive as a ZIP file, in the order of their names. An archive is made in one task and memory, so it should hold megabytes, not gigabytes."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(pdf[entry], pdf[content])):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
        return pd.DataFrame({"archive": [key[0]], "content": [out.getvalue()]})

    return df.select(F.col(archive).cast("string").alias(archive), entry, content).groupBy(archive).applyInPandas(run, "archive string, content binary")


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """archive, entry, content of every file in the archives of a path; broken archives give none."""
    return entries_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("archive"), "content"))


def entries_of(files: DataFrame) -> DataFrame:
    """archive, entry, content of every file in archives given as rows (archive, content); broken archives give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["archive"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for x in z.infolist():
                            if not x.is_dir():
                                yield pd.DataFrame({"archive": [name], "entry": [x.filename], "content": [z.read(x)]})
                except zipfile.BadZipFile:
                    continue

    return files.select("archive", "content").mapInPandas(run, "archive string, entry string, content binary")


def normalized_split(split):
    """train, validation (also from val) or test; any other name is an error."""
    s = F.lower(F.trim(split))
    return F.when(s == "val", "validation").when(s.isin("train", "validation", "test"), s).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(s, F.lit("null")))))


def read_labels(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """patch_id, label, split of a label table in Parquet or CSV."""
    df = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", "true").schema("patch_id STRING, label INT, split STRING").csv(path)
    return df.select("patch_id", "label", normalized_split(F.col("split")).alias("split"))


def read_index(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """patch_id (text) and label of a table of labels, one row for each id: the highest label, of several."""
    return labels.groupBy(F.col(id_col).cast("string").alias("patch_id")).agg(F.max(label_col).alias("label"))


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both, those of ``new`` where both have a key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


COMPLETE = "_COMPLETE"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    fs, place = _hadoop(spark, path)
    out = fs.create(place, False)
    out.write(bytearray(content))
    out.close()


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str, bool]]:
    """(number, path, complete) of the versions below a folder, oldest first."""
    fs, place = _hadoop(spark, root)
    if not fs.exists(place):
        return []
    found = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if re.fullmatch(r"version-\d{8}-\w+", name):
            path = f"{root.rstrip('/')}/{name}"
            found.append((int(name.split("-")[1]), path, fs.exists(_hadoop(spark, f"{path}/{COMPLETE}")[1])))
    return sorted(found)


def save_checkpoint(payload: DataFrame, root: str, about: dict) -> int:
    """A new version of a model's state: the table ``payload``, then ``about`` (figures, classes, modalities) as JSON, then a marker.

    Nothing is overwritten, so readers of older versions go on; a writer that dies before the marker leaves a torn version, which
    no reader takes. Two writers at once make two versions of one number, the later name of which counts. Gives the number.
    """
    spark = payload.sparkSession
    number = max((n for n, _, _ in _versions(spark, root)), default=0) + 1
    path = f"{root.rstrip('/')}/version-{number:08d}-{uuid.uuid4().hex}"
    payload.write.parquet(f"{path}/payload")
    _put(spark, f"{path}/about.json", json.dumps({**about, "version": number}, sort_keys=True).encode())
    _put(spark, f"{path}/{COMPLETE}", b"")
    return number


def load_checkpoint(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Payload and about (one row, one string of JSON) of the newest complete version, or of the one asked for; without one it is an error."""
    whole = [(n, path) for n, path, complete in _versions(spark, root) if complete and version in (None, n)]
    if not whole:
        raise FileNotFoundError(f"no complete version in {root}")
    path = whole[-1][1]
    return spark.read.parquet(f"{path}/payload"), spark.read.text(f"{path}/about.json", wholetext=True)


def first_covered(candidates: list[DataFrame], value: str, least_pct: float = 5.0) -> DataFrame:
    """The first candidate with enough cells that are known and positive, from one row each; else the last."""
    for df in candidates[:-1]:
        n, fine = df.agg(F.count(F.lit(1)), F.count_if(F.col(value) > 0)).first()
        if n and 100.0 * fine / n >= least_pct:
            return df
    return candidates[-1]


def _parts(blob: bytes) -> list[list[list[tuple[float, float]]]]:
    """The rings, the outer one first, of every polygon in a GeoPackage geometry: a header, a box as its flags say, then
    well-known binary (polygon or multipolygon). Rings aren't closed; empty polygons are left out."""
    at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]

    def head(at: int) -> tuple[str, int, int]:
        order = "<" if blob[at] else ">"
        return order, *struct.unpack_from(order + "II", blob, at + 1)

    _, kind, count = head(at)
    if kind % 1000 == 6:
        at += 9
    else:
        count = 1
    out = []
    for _ in range(count):
        order, kind, n = head(at)
        if kind % 1000 != 3:
            raise ValueError(f"not a polygon: geometry type {kind}")
        at += 9
        width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        rings = []
        for _ in range(n):
            size = struct.unpack_from(order + "I", blob, at)[0]
            values = struct.unpack_from(f"{order}{size * width}d", blob, at + 4)
            at += 4 + 8 * size * width
            ring = [(values[k], values[k + 1]) for k in range(0, len(values), width)]
            rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
        if rings:
            out.append(rings)
    return out


def _blob(srs: int, rings: list) -> bytes:
    """A polygon as a GeoPackage geometry: header, box, well-known binary; rings are closed."""
    xs, ys = [p["x"] for r in rings for p in r], [p["y"] for r in rings for p in r]
    head = b"GP\x00\x03" + struct.pack("<i4d", srs, min(xs), max(xs), min(ys), max(ys))
    body = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        closed = [*ring, ring[0]]
        body.append(struct.pack("<I", len(closed)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in closed))
    return head + b"".join(body)


def geopackages(df: DataFrame, fid: str, layer: str, srs: int, features: int = 10_000) -> DataFrame:
    """name, content: shapes (``fid``, ring, perhaps holes) as GeoPackage files of about so many features, dealt by a hash of the id.

    The files are rows of a table (tasks of a cluster have no common folder to write files in); ``features_of`` reads
    them, and so does any GeoPackage reader once the content is saved. Shapes without corners are left out.
    """
    n = max(1, -(-df.count() // features))
    rows = df.where(F.size("ring") > 0).select(F.col(fid).cast("long").alias("fid"), "ring", (F.col("holes") if "holes" in df.columns else F.filter(F.array("ring"), lambda _: F.lit(False))).alias("holes"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined')", (f"EPSG:{srs}", srs, srs))
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, srs_id INTEGER)")
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srs))
        name = '"' + layer.replace('"', '""') + '"'
        db.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY, geom BLOB)")
        told = ((int(i), _blob(srs, [r, *h])) for i, r, h in sorted(zip(pdf["fid"], pdf["ring"], pdf["holes"]), key=lambda x: x[0]))
        db.executemany(f"INSERT OR IGNORE INTO {name} VALUES (?, ?)", told)
        db.commit()
        return pd.DataFrame({"name": [f"{layer}-{key[0]:06d}.gpkg"], "content": [bytes(db.serialize())]})

    return rows.groupBy(F.pmod(F.xxhash64("fid"), F.lit(n)).cast("int").alias("file")).applyInPandas(run, "name string, content binary")


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """The polygons of the GeoPackage files of a path; see ``features_of``."""
    return features_of(spark.read.format("binaryFile").load(path).select("content"), layer)


def features_of(files: DataFrame, layer: str | None = None) -> DataFrame:
    """layer, fid, srs_id, part (from 0), ring, holes (array of rings) of every polygon of a GeoPackage's layer (the first if
    none is named); a multipolygon has one row for each part. ``files`` has the content of a file in each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                name, column, srs = next((x for x in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid") if layer in (None, x[0])), (None, None, None))
                if name is None:
                    raise ValueError(f"no layer {layer}")
                quote = lambda x: '"' + x.replace('"', '""') + '"'
                rows = db.execute(f"SELECT rowid, {quote(column)} FROM {quote(name)} WHERE {quote(column)} IS NOT NULL").fetchall()
                points = lambda ring: [{"x": x, "y": y} for x, y in ring]
                parts = [(fid, k, points(rings[0]), [points(x) for x in rings[1:]]) for fid, blob in rows for k, rings in enumerate(_parts(blob))]
                yield pd.DataFrame({"layer": name, "fid": [x[0] for x in parts], "srs_id": srs, "part": [x[1] for x in parts], "ring": [x[2] for x in parts], "holes": [x[3] for x in parts]})

    return files.select("content").mapInPandas(run, "layer string, fid long, srs_id int, part int, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
